"""Merging the observations of samples: union, first-wins dedup, per-position totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allele_key(alleles: Column) -> Column:
    """Alleles in a fixed order as text; maps themselves can't be grouped, and text hashes fast."""
    return F.to_json(F.array_sort(F.map_entries(alleles)))


def union_samples(frames: list[DataFrame], lengths: list[int] | None = None) -> DataFrame:
    """All samples with file_ord; their references must be of one length."""
    if not frames:
        raise ValueError("nothing to merge")
    if lengths and len(set(lengths)) > 1:
        raise ValueError(f"references of different lengths: {sorted(set(lengths))}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("file_ord", F.lit(i)) for i, f in enumerate(frames)])


def deduplicate(obs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (position, alleles, provenance): the first by (file_ord, row_ord)."""
    w = Window.partitionBy(*extra, "position", allele_key(F.col("all_alleles")), "provenance").orderBy("file_ord", "row_ord")
    return obs.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def with_totals(obs: DataFrame) -> DataFrame:
    """Per-position depth and pair and insert totals on every row; local_coverage = [depth].

    Totals are grouped first and joined back, so that a deep position is summed map-side.
    """
    sums = ["total_paired_count", "proper_pair_count", "insert_size_sum", "insert_size_count"]
    totals = obs.groupBy("position").agg(F.count("*").cast("int").alias("__depth"), *[F.sum(c).alias(f"__{c}") for c in sums])
    out = obs.drop(*sums).join(totals, "position")
    out = out.withColumn("local_coverage", F.array("__depth")).withColumn("coverage_window_variant_offset", F.lit(0))
    return out.withColumnsRenamed({f"__{c}": c for c in sums}).drop("__depth")


def merge(obs: DataFrame, reset: bool = False) -> DataFrame:
    """Dedup, then totals. The result doesn't depend on the order of the samples, but for which
    of equal observations stays. reset: columns that a bare record lacks get their defaults."""
    out = with_totals(deduplicate(obs))
    if reset:
        plain = {"variant_type": F.lit("snp"), "in_tandem_repeat": F.lit(False), "kmer_uniqueness": F.lit(1.0), "strand": F.lit("+")}
        out = out.withColumns({k: v for k, v in plain.items() if k in out.columns})
        if "mate_info" in out.columns:
            out = out.withColumn("mate_info", F.lit(None).cast(out.schema["mate_info"].dataType))
    return out
