"""Deferred filters over observations: thresholds, presets and an expression language.

All of them compile to one Column, so that Catalyst pushes what it can to the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars


@dataclass(frozen=True)
class Thresholds:
    min_coverage: int | None = None
    max_coverage: int | None = None
    min_mapq: int | None = None
    max_mapq: int | None = None
    min_base_quality: float | None = None
    min_allele_frequency: float | None = None
    min_kmer_uniqueness: float | None = None
    exclude_tandem_repeats: bool = False
    require_proper_pairs: float | None = None
    #: (mean, standard deviation, sigma) of insert sizes
    exclude_discordant_pairs: tuple[float, float, float] | None = None
    min_insert_size: int | None = None
    max_insert_size: int | None = None
    require_both_mates_mapped: bool = False


#: The two presets.
PRESETS = {
    "strict": Thresholds(min_coverage=10, min_mapq=30, min_allele_frequency=0.10, exclude_tandem_repeats=True),
    "tolerant": Thresholds(min_coverage=3, min_mapq=20, min_allele_frequency=0.02),
}


def preset(name: str | None = None, **overrides) -> Thresholds:
    """A preset with the given values in place of its own."""
    if name is not None and name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(sorted(PRESETS))}")
    unknown = set(overrides) - {f.name for f in fields(Thresholds)}
    if unknown:
        raise ValueError(f"unknown thresholds: {sorted(unknown)}")
    return replace(PRESETS[name] if name else Thresholds(), **{k: v for k, v in overrides.items() if v is not None})


def pair_fraction(value: float) -> float:
    """A fraction, or a percentage above 1."""
    value = value / 100 if value > 1 else value
    if not 0 <= value <= 1:
        raise ValueError("the share of proper pairs lies between 0 and 1, or 0 and 100 percent")
    return value


def condition(t: Thresholds) -> Column:
    """One conjunction over observation columns; never null."""
    cov = scalars.coverage_at_variant(F.col("local_coverage"), F.col("coverage_window_variant_offset"))
    insert = scalars.mean_insert_size(F.col("insert_size_sum"), F.col("insert_size_count"))
    tests: list[Column] = []

    def need(on, test: Column, missing: bool) -> None:
        if on is not None and on is not False:
            tests.append(F.coalesce(test, F.lit(missing)))

    need(t.min_coverage, cov >= t.min_coverage, False)
    need(t.max_coverage, cov <= t.max_coverage, True)
    need(t.min_mapq, F.col("mapq") >= t.min_mapq, False)
    need(t.max_mapq, F.col("mapq") <= t.max_mapq, False)
    need(t.min_base_quality, F.col("avg_base_quality") >= t.min_base_quality, False)
    if t.min_allele_frequency is not None:
        some = scalars.allele_total(F.col("all_alleles")) > 0
        need(True, some & (scalars.max_alt_frequency(F.col("all_alleles"), F.col("ref_base")) >= t.min_allele_frequency), False)
    need(t.min_kmer_uniqueness, F.col("kmer_uniqueness") >= t.min_kmer_uniqueness, False)
    need(t.exclude_tandem_repeats, ~F.col("in_tandem_repeat"), True)
    if t.require_proper_pairs is not None:
        share = scalars.proper_pair_fraction(F.col("proper_pair_count"), F.col("total_paired_count"))
        need(True, share >= pair_fraction(t.require_proper_pairs), False)
    if t.exclude_discordant_pairs is not None:
        mean, sd, sigma = t.exclude_discordant_pairs
        need(True, insert <= mean + sigma * sd, True)
    need(t.min_insert_size, F.round(insert) >= t.min_insert_size, True)
    need(t.max_insert_size, F.round(insert) <= t.max_insert_size, True)
    need(t.require_both_mates_mapped, F.col("mate_info.mate_mapped"), False)
    every = F.lit(True)
    for x in tests:
        every = every & x
    return every


def apply(df: DataFrame, t: Thresholds) -> DataFrame:
    return df.filter(condition(t))


def read_or_contig(bases: Column, limit: int = 5000) -> Column:
    return F.when(F.length(bases) >= limit, "contig").otherwise("read")


def outcome(seeds: Column, edit: Column, length: Column, cutoff: float | None = None, report: float = 0.95) -> Column:
    """What became of a read: no_alignment, fast_cutoff past the strategy's divergence, placed
    from the reported identity on; below it, below_threshold with shared seeds and no_seed without."""
    base = F.when(edit.isNull(), "no_alignment")
    if cutoff is not None:
        base = base.when(~within_divergence(edit, length, cutoff), "fast_cutoff")
    base = base.when(scalars.identity(edit, length) >= report, "placed")
    return base.when(F.coalesce(seeds, F.lit(0)) > 0, "below_threshold").otherwise("no_seed")


#: Fixed value: the fast strategy drops reads whose best alignment differs in more than this share.
FAST_DIVERGENCE = 0.20


def within_divergence(edit: Column, length: Column, cutoff: float = FAST_DIVERGENCE) -> Column:
    return edit / F.greatest(length, F.lit(1)) <= cutoff


#: SAM flag bits.
FLAGS = {"paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "first": 0x40, "second": 0x80}


def flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAGS[name])) != 0


class ExpressionError(ValueError):
    pass


class UnknownField(ExpressionError):
    pass


class MalformedExpression(ExpressionError):
    pass


class UnmatchedParen(ExpressionError):
    pass


class MissingOperand(ExpressionError):
    pass


_EPSILON = 2.220446049250313e-16
_TOKENS = re.compile(r"\s*(\|\||&&|>=|<=|==|!=|[!()<>]|[+-]?\d+(?:\.\d+)?|[A-Za-z_]\w*)")
_COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: (a > b) | (F.abs(a - b) < _EPSILON),
    "<=": lambda a, b: (a < b) | (F.abs(a - b) < _EPSILON),
    "==": lambda a, b: F.abs(a - b) < _EPSILON,
    "!=": lambda a, b: F.abs(a - b) >= _EPSILON,
}


def expression_fields() -> dict[str, Column]:
    return {
        "coverage": scalars.coverage_at_variant(F.col("local_coverage"), F.col("coverage_window_variant_offset")),
        "mapq": F.col("mapq"),
        "allele_frequency": scalars.max_alt_frequency(F.col("all_alleles"), F.col("ref_base")),
        "base_quality": F.col("avg_base_quality"),
        "confidence": F.col("confidence"),
        "kmer_uniqueness": F.col("kmer_uniqueness"),
        "edit_distance": F.col("edit_distance"),
        "in_tandem_repeat": F.col("in_tandem_repeat").cast("int"),
    }


def parse_expression(text: str, known: dict[str, Column] | None = None) -> Column:
    """``mapq >= 30 && !(coverage < 5 || in_tandem_repeat == 1)`` as a Column.

    Precedence: ``||`` below ``&&`` below ``!`` below parentheses. A comparison is a field, an
    operator and a number without exponent. A comparison with a missing value is false.
    """
    known = known or expression_fields()
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKENS.match(text, at)
        if not m:
            raise MalformedExpression(f"unexpected text at {at}: {text[at:at + 10]!r}")
        tokens.append(m[1])
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        if place >= len(tokens):
            raise MissingOperand("the expression ends early")
        place += 1
        return tokens[place - 1]

    def any_of() -> Column:
        left = all_of()
        while peek() == "||":
            take()
            left = left | all_of()
        return left

    def all_of() -> Column:
        left = negated()
        while peek() == "&&":
            take()
            left = left & negated()
        return left

    def negated() -> Column:
        if peek() == "!":
            take()
            return ~negated()
        if peek() == "(":
            take()
            inner = any_of()
            if peek() != ")":
                raise UnmatchedParen("a parenthesis is not closed")
            take()
            return inner
        return comparison()

    def comparison() -> Column:
        name = take()
        if name in ("||", "&&", ")") or name in _COMPARE:
            raise MissingOperand(f"an operand is missing before {name!r}")
        if not re.match(r"[A-Za-z_]", name):
            raise MalformedExpression(f"a field was expected, not {name!r}")
        if name not in known:
            raise UnknownField(name)
        op = take()
        if op not in _COMPARE:
            raise MalformedExpression(f"a comparison was expected, not {op!r}")
        value = take()
        if not re.fullmatch(r"[+-]?\d+(\.\d+)?", value):
            raise MalformedExpression(f"a number was expected, not {value!r}")
        return F.coalesce(_COMPARE[op](known[name].cast("double"), F.lit(float(value))), F.lit(False))

    if not tokens:
        raise MissingOperand("the expression is empty")
    found = any_of()
    if peek() == ")":
        raise UnmatchedParen("a parenthesis was never opened")
    if peek() is not None:
        raise MalformedExpression(f"unexpected {peek()!r}")
    return found
