"""Quality rules: one table of thresholds, compiled into one projection of native expressions.

No user function runs. `measure` adds the counts, `verdict` compiles a table of rules over
ratios of them. Windows of three words are sorted by hashes within one text; equal hashes
count only where the words are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, named

#: Common function words of the languages served.
STOP_WORDS = (
    "the of and to in a is that it for was on are with as be this by from at or an not which he his they have "
    "der die das und in zu den ist von mit nicht ein eine auf dem des sich im für auch als "
    "le la les de des et en un une est que qui dans pour pas sur au par avec il elle du ne se ce "
    "el los las del y que en un una es por con no se su al lo para como más"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Passes where top / bottom lies in [low, high]; a zero bottom passes. No bottom: top itself."""

    name: str
    top: str
    bottom: str | None
    low: float | None = None
    high: float | None = None


#: The production table. Columns are those that `measure` makes.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.10),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.90),
)


#: A window's key keeps this many low bits for its place, in texts of so many words at most;
#: longer texts sort pairs of hash and place.
PLACE_BITS = 17
#: Bits of a window's hash that are kept; tests lower it, so that hashes collide.
HASH_BITS = 64


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' counts.

    A null text has no words or lines. Columns of these names are replaced, others stay, and
    repeated rows stay repeated; an empty table gives an empty one. Long texts are measured
    whole: every step is linear in the words but one sort of their windows.
    """
    made = [
        "n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines",
        "n_ellipsis_lines", "n_bullet_lines", "n_repeat_words",
    ]
    keep = [c for c in df.columns if c not in made]
    body = F.coalesce(named(text), F.lit(""))
    step = df.select(
        *map(named, keep),
        F.array_remove(F.split(body, WORD_SPLIT), "").alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        body.alias("__text"),
    )
    stop = sorted(set(STOP_WORDS))
    lines = F.col("__lines")
    step = step.select(
        *map(named, keep),
        F.col("__words"),
        F.size("__words").cast("long").alias("n_words"),
        (F.length("__text") - F.regexp_count("__text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size(F.filter("__words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[•*-]"))).cast("long").alias("n_bullet_lines"),
    )
    return step.select(*map(named, keep), *[F.col(c) for c in made[:-1]], repeated_words(F.col("__words")).alias("n_repeat_words"))


def _let(value: Column, then) -> Column:
    """then(x) with x bound to the value, which so is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(words: Column) -> Column:
    """Words covered by windows of three that stand twice or more in the array of words.

    A window's key is the upper bits of its hash over its place, so that one sort of primitive
    longs brings equal windows together; texts beyond 2^17 words sort pairs of both. Neighbours
    of equal hash are then compared word by word. Should two of them differ, the text's windows
    are sorted once more, by their words.
    """
    places = (1 << PLACE_BITS) - 1
    kept = ((1 << 64) - (1 << (64 - HASH_BITS))) - (1 << 64)  # as a signed number

    def gram(h: Column, x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.lit(kept))

    def whole(made: Column) -> Column:
        return F.slice(made, 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def packed(h: Column) -> Column:
        keys = F.transform(h, lambda x, i: gram(h, x, i).bitwiseAND(F.lit(~places)).bitwiseOR(i.cast("long")))
        same = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0
        return _let(F.sort_array(whole(keys)), lambda s: _let(twins(s, same), lambda t: counted(t, same, lambda x: x.bitwiseAND(F.lit(places)).cast("int"))))

    def paired(h: Column) -> Column:
        keys = F.transform(h, lambda x, i: F.struct(gram(h, x, i).alias("g"), i.alias("i")))
        same = lambda x, y: x["g"] == y["g"]
        return _let(F.sort_array(whole(keys)), lambda s: _let(twins(s, same), lambda t: counted(t, same, lambda x: x["i"])))

    def by_words() -> Column:
        keys = F.transform(words, lambda x, i: F.struct(x.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return _let(F.sort_array(whole(keys)), lambda s: covered(F.transform(twins(s, same), lambda x: x["i"])))

    def twins(s: Column, same) -> Column:
        return F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

    def counted(t: Column, same, place) -> Column:
        """Words covered by the windows of t, or -1 where neighbours of equal hash differ."""

        def differ(x: Column, k: Column) -> Column:
            y = F.get(t, k - 1)
            i, j = place(x), place(y)
            unequal = F.lit(False)
            for step in range(3):
                unequal = unequal | (F.get(words, i + step) != F.get(words, j + step))
            return (k > 0) & same(x, y) & unequal

        clash = F.size(F.filter(t, differ)) > 0
        return F.when(clash, F.lit(-1)).otherwise(covered(F.transform(t, place)))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(at),
            start,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = _let(hashes, lambda h: F.when(F.size(h) <= places, packed(h)).otherwise(paired(h)))
    return _let(found, lambda n: F.when(n >= 0, n).otherwise(by_words())).cast("long")


def verdict(rules=RULES) -> Column:
    """The rules as one boolean column; it is never null."""
    every = F.lit(True)
    for r in rules:
        ratio = F.col(r.top) / F.nullif(F.col(r.bottom), F.lit(0)) if r.bottom else F.col(r.top)
        for bound, ok in ((r.low, ratio >= F.lit(r.low)), (r.high, ratio <= F.lit(r.high))):
            if bound is not None:
                every = every & F.coalesce(ok, F.lit(True))
    return every


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`measure` with base_failed and kept; kept is false where base_failed is true.

    Nulls, repeats and empty tables are as in `measure`: a null or empty text fails. No row goes.
    """
    out = measure(df.drop("base_failed", "kept"), text)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))


def keep(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that `judge` keeps, with the columns of ``df``, in their own values even where
    they are named like a measure. Null and empty texts go; equal rows stay or go together.

    A filter on ``kept`` would be pushed below the measures and would repeat all of them
    within its condition; tying it to a row number, which no filter passes, keeps it above.
    """
    rows = df.select(named(text).alias("__body"), F.struct(*map(named, df.columns)).alias("__row"))
    judged = judge(rows, "__body", rules).withColumn("__kept", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return judged.filter("__kept").select("__row.*")


#: The same in DuckDB for {table}; windows are compared as text instead of by hash.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM {table}),
g AS (
  SELECT row_number() OVER () AS rid, *,
         list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams
  FROM t),
w AS (SELECT rid, unnest(grams) AS gram, unnest(generate_series(1, len(words) - 2)) AS i FROM g WHERE len(words) >= 3),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM w) WHERE n >= 2),
c AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT g.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•*-]')))::BIGINT AS n_bullet_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules} AS kept FROM b
"""


def sql(source: str = "documents", rules=RULES) -> str:
    parts = []
    for r in rules:
        ratio = f"{r.top}::DOUBLE / nullif({r.bottom}, 0)" if r.bottom else r.top
        parts += [f"coalesce({ratio} >= {r.low}, true)"] * (r.low is not None)
        parts += [f"coalesce({ratio} <= {r.high}, true)"] * (r.high is not None)
    return SQL.format(table=source, rules=" AND ".join(parts), stop=", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))))
