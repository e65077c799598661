"""Scalar functions over bases, qualities, coverage, alleles and CIGARs, as native columns.

CIGAR letters: M match, X mismatch, I target-only base, D query-only base.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(bases: Column) -> Column:
    """A-T and C-G in both cases, other characters as they are, reversed."""
    return F.reverse(F.translate(bases, "ACGTacgt", "TGCAtgca"))


def detect_alphabet(bases: Column) -> Column:
    """'protein' where a letter occurs that no nucleotide code uses, else 'dna'."""
    return F.when(F.upper(bases).rlike("[EFILPQ]"), "protein").otherwise("dna")


def avg_quality(quality: Column) -> Column:
    """Mean of the qualities; null without them, 0 where there are none."""
    total = F.aggregate(quality, F.lit(0).cast("bigint"), lambda a, q: a + q)
    return F.when(quality.isNull(), None).when(F.size(quality) == 0, F.lit(0.0)).otherwise(total / F.size(quality))


def quality_at(quality: Column, pos: Column) -> Column:
    return F.get(quality, pos)


def quantize(value: Column, cap: int | None = 255) -> Column:
    """To the nearest five; halves can't occur. cap: the largest value of a track, or None."""
    five = F.floor((value + 2) / 5).cast("int") * 5
    return F.least(five, F.lit(cap)) if cap is not None else five


def coverage_at_variant(local_coverage: Column, offset: Column) -> Column:
    return F.get(local_coverage, offset)


def proper_pair_fraction(proper: Column, total: Column) -> Column:
    return proper / F.nullif(total, F.lit(0))


def mean_insert_size(total: Column, count: Column) -> Column:
    return total / F.nullif(count, F.lit(0))


def is_discordant(insert: Column, mean: Column, sd: Column, sigma: float = 3.0) -> Column:
    """Two-sided; an insert of 0 is unknown and never discordant."""
    limit = (sd * F.lit(sigma)).cast("int")
    return (insert != 0) & (F.abs(F.abs(insert) - mean) > limit)


def extract_cigar_ops(cigar: Column) -> Column:
    """How many letters M, I and D the CIGAR has; X is not counted."""
    return F.length(F.regexp_replace(cigar, "[^MID]", ""))


def allele_total(alleles: Column) -> Column:
    return F.aggregate(F.map_values(alleles), F.lit(0).cast("bigint"), lambda a, n: a + n)


def allele_frequency(alleles: Column, allele: Column) -> Column:
    return F.coalesce(F.coalesce(F.try_element_at(alleles, allele), F.lit(0)) / F.nullif(allele_total(alleles), F.lit(0)), F.lit(0.0))


def max_alt_frequency(alleles: Column, ref: Column) -> Column:
    """The largest share of an allele other than the reference; 0 without one."""
    alt = F.array_max(F.map_values(F.map_filter(alleles, lambda k, _: k != ref)))
    return F.coalesce(alt / F.nullif(allele_total(alleles), F.lit(0)), F.lit(0.0))


def parse_cigar(cigar: Column) -> Column:
    """array<struct<len int, op string>>; a letter without a number counts one."""
    ops = F.arrays_zip(
        F.regexp_extract_all(cigar, F.lit(r"(\d*)(\D)"), 1).alias("n"),
        F.regexp_extract_all(cigar, F.lit(r"(\d*)(\D)"), 2).alias("op"),
    )
    return F.transform(ops, lambda x: F.struct(F.when(x["n"] == "", 1).otherwise(x["n"].cast("int")).alias("len"), x["op"].alias("op")))


def levenshtein_from_cigar(cigar: Column) -> Column:
    return F.aggregate(parse_cigar(cigar), F.lit(0), lambda a, x: a + F.when(x["op"] != "M", x["len"]).otherwise(0))


def indel_runs(cigar: Column) -> Column:
    return F.regexp_count(cigar, F.lit("[ID]"))


def content_hash(bases: Column) -> Column:
    """SHA-256 of the bases alone, in hexadecimal."""
    return F.sha2(bases, 256)


def cache_key(bases: Column) -> Column:
    """A 64-bit key; only its equality counts."""
    return F.xxhash64(bases)


def space_label(name: Column, hash_: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.nullif(name, F.lit("")), r"[^A-Za-z0-9_.-]", "_"), F.substring(hash_, 1, 16))


def mate_id(read_id: Column, is_first: Column) -> Column:
    """The id of the other mate: trailing /1s, then /2s go; a first mate's mate is /2."""
    bare = F.regexp_replace(F.regexp_replace(read_id, "(/1)+$", ""), "(/2)+$", "")
    return F.concat(bare, F.when(is_first, "/2").otherwise("/1"))


def identity(edit: Column, length: Column) -> Column:
    return F.lit(1.0) - edit / F.greatest(length, F.lit(1))


def composite_confidence(unique: Column, ident: Column) -> Column:
    """Identity where the k-mer is unique, else 0."""
    return F.when(unique, F.lit(1.0)).otherwise(F.lit(0.0)) * ident


def local_window(position: Column, radius: int, length: Column) -> Column:
    """struct<lo, hi, offset>: the half-open window around a position, and its place in it."""
    lo = F.greatest(position - radius, F.lit(0))
    return F.struct(lo.alias("lo"), F.least(position + radius + 1, length).alias("hi"), (position - lo).alias("offset"))


def repeat_count(start: Column, end: Column, period: Column) -> Column:
    """Copies of the unit in an inclusive region."""
    return F.floor((end - start + 1) / period).cast("int")


def compression_ratio(runs: Column, total: Column) -> Column:
    return F.coalesce(runs * 8 / F.nullif(total, F.lit(0)), F.lit(0.0))


def truth_of_name(read_id: Column) -> Column:
    """struct<contig, lo, hi> from names of simulated reads, CONTIG_START_END_..., what follows
    the last slash left out; null elsewhere, and for reads that were placed at random (rand_...)."""
    bare = F.regexp_replace(read_id, "/[^/]*$", "")
    part = lambda g: F.regexp_extract(bare, r"^(.+?)_(\d+)_(\d+)_", g)  # noqa: E731  fixed by the simulators' format
    a, b = F.nullif(part(2), F.lit("")).cast("bigint"), F.nullif(part(3), F.lit("")).cast("bigint")
    return F.when(a.isNotNull() & ~bare.startswith("rand_"), F.struct(part(1).alias("contig"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def matching_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), F.lit(False))
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")
