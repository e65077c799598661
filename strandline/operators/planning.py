"""Planning: use cases, task lists, chunks, palettes of reference spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def use_case(inputs: DataFrame, has_reference: bool, contig_length: int = 5000) -> DataFrame:
    """One row (use_case): 1 one sequence or none alone, 2 reads on a reference, 3 several files
    without a reference (contigs and reads), 4 contigs: one file of several sequences without a
    reference, or a reference with inputs that are all of contig length.

    inputs: (file_idx, seq_idx, bases) without the reference. Without one only files and
    sequences count, not lengths.
    """
    a = inputs.agg(F.countDistinct("file_idx").alias("files"), F.coalesce(F.min((F.length("bases") >= contig_length).cast("int")), F.lit(0)).alias("all_long"), F.count("*").alias("n"))
    with_ref = F.when(F.col("all_long") == 1, 4).otherwise(2)
    without = F.when(F.col("files") > 1, 3).when(F.col("n") > 1, 4).otherwise(1)
    return a.select((with_ref if has_reference else without).alias("use_case"))


def tasks_to_reference(items: DataFrame, reference: DataFrame) -> DataFrame:
    """Every item against the one reference; items and reference: (id, idx)."""
    one = reference.select(F.col("id").alias("target_id"), F.col("idx").alias("target_idx")).limit(1)
    return items.join(F.broadcast(one)).select(F.col("idx").alias("query_idx"), "target_idx", F.col("id").alias("query_id"), "target_id")


def tasks_to_centroid(items: DataFrame, centroid: DataFrame) -> DataFrame:
    """Every other item against the centroid."""
    return tasks_to_reference(items, centroid).filter("query_idx <> target_idx")


def tasks_all_pairs(items: DataFrame) -> DataFrame:
    """Each unordered pair once, i < j: the result itself is quadratic in the contigs."""
    a = items.select(F.col("idx").alias("query_idx"), F.col("id").alias("query_id"))
    b = items.select(F.col("idx").alias("target_idx"), F.col("id").alias("target_id"))
    return a.join(b, F.col("query_idx") < F.col("target_idx")).select("query_idx", "target_idx", "query_id", "target_id")


def chunk_of(idx: Column, n: int, chunks: int) -> Column:
    """Equal slices of ceil(n / chunks), the last ones perhaps short or empty."""
    size = max(1, -(-n // max(1, chunks)))
    return F.least(F.floor(idx / size), F.lit(chunks - 1)).cast("int")


def chunk_sizes(items: DataFrame, chunks: int) -> DataFrame:
    n = items.count()
    return items.withColumn("chunk_id", chunk_of(F.col("idx"), n, chunks)).groupBy("chunk_id").agg(F.count("*").alias("items"))


def global_to_local(counts: DataFrame) -> DataFrame:
    """(file_idx, first, items): where each file's records start in the global order, the first
    file left out as the target. counts: (file_idx, items)."""
    rest = counts.filter("file_idx > 0")
    w = Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    return rest.select("file_idx", F.coalesce(F.sum("items").over(w), F.lit(0)).cast("bigint").alias("first"), "items")


def read_pool(reads: DataFrame, palette: DataFrame) -> DataFrame:
    """Reads whose bases are no reference space's: an anti join on SHA-256."""
    return reads.withColumn("content_hash", F.sha2("bases", 256)).join(palette.select("content_hash").distinct(), "content_hash", "left_anti")


def resolve_palette(wanted: DataFrame, palette: DataFrame, sealed: bool = False) -> DataFrame:
    """wanted (content_hash, ...) with ``hit``; a sealed palette raises where one is missing."""
    known = palette.select("content_hash").distinct().withColumn("hit", F.lit(True))
    out = wanted.join(known, "content_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if sealed:
        out = out.withColumn("hit", F.when(F.col("hit"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not in the sealed palette: "), F.col("content_hash"))).cast("boolean")))
    return out


def placements_by_space(query_sketch: DataFrame, spaces: DataFrame) -> DataFrame:
    """Candidates of reads in every space at once: the seed join is keyed by space, so that the
    result for {A, B} is the union of those for A and B. spaces: (space, hash, pos)."""
    q = query_sketch.select(F.col("seq_id").alias("query_id"), "hash", F.col("pos").alias("query_pos"))
    return q.join(spaces, "hash").groupBy("query_id", "space", (F.col("pos") - F.col("query_pos")).alias("diagonal")).agg(F.count("*").alias("votes"))


def worker_path(pattern: str, worker: Column) -> Column:
    return F.replace(F.lit(pattern), F.lit("{worker}"), worker.cast("string"))


def check_worker_paths(pattern: str, workers: int) -> list[str]:
    """The output paths; raises where two workers would share one."""
    paths = [pattern.replace("{worker}", str(i)) for i in range(workers)]
    if len(set(paths)) < len(paths):
        raise ValueError("the output pattern needs {worker}")
    return paths


def missing_outputs(planned: DataFrame, existing: DataFrame) -> DataFrame:
    return planned.join(existing, "path", "left_anti")


def require_all(planned: DataFrame, existing: DataFrame) -> None:
    gone = [r[0] for r in missing_outputs(planned, existing).select("path").limit(10).collect()]
    if gone:
        raise FileNotFoundError(f"batch outputs are missing: {gone}")


def validate(reference: bool = False, worker: bool = False, ensure: bool = False, sealed: bool = False, gap_model: str = "linear", strategy: str = "balanced", alphabet: str = "auto") -> None:
    """The rules on options that exclude each other."""
    if sum((reference, worker, ensure)) > 1:
        raise ValueError("reference, worker and ensure exclude each other")
    if sealed and not reference:
        raise ValueError("sealed needs reference")
    if gap_model not in ("linear", "affine") or strategy not in ("fast", "balanced", "sensitive"):
        raise ValueError("unknown gap model or strategy")
    if gap_model == "affine" and strategy != "sensitive":
        raise ValueError("affine gaps need the sensitive strategy")
    if alphabet not in ("auto", "dna", "protein"):
        raise ValueError(f"unknown alphabet {alphabet!r}")
