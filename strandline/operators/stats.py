"""Statistics: insert sizes, placements, accuracy, replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import truth_of_name


def insert_size_sample(pairs: DataFrame, size: int = 10_000, absolute: bool = False) -> DataFrame:
    """The first proper pairs of a known insert size, by read_idx."""
    known = pairs.filter("proper_pair and insert_size <> 0").orderBy("read_idx").limit(size)
    return known.select(F.abs("insert_size").alias("insert_size") if absolute else F.col("insert_size"))


def insert_size_distribution(sample: DataFrame, least: int = 100, orientation: str = "FR") -> DataFrame:
    """(mean, std_dev, orientation, sample_size) in whole numbers, or no row below ``least``.

    The deviation is around the truncated mean: sum (x-m)^2 = s2 - 2 m s + n m^2, in one pass.
    """
    x = F.col("insert_size").cast("bigint")
    a = sample.agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("s2")).filter(F.col("n") >= least)
    m = F.expr("s div n")
    return a.withColumn("m", m).select(
        F.col("m").cast("int").alias("mean"),
        F.floor(F.sqrt((F.col("s2") - 2 * F.col("m") * F.col("s") + F.col("n") * F.col("m") * F.col("m")) / F.col("n"))).cast("int").alias("std_dev"),
        F.lit(orientation).alias("orientation"),
        F.col("n").cast("int").alias("sample_size"),
    )


def multi_map_fraction(placements: DataFrame) -> DataFrame:
    """(pos, fraction): of the queries placed at pos, the share that has more than one placement."""
    places = placements.select("query_id", "pos").distinct()
    n = placements.groupBy("query_id").agg(F.count("*").alias("n"))
    return places.join(n, "query_id").groupBy("pos").agg(F.avg((F.col("n") > 1).cast("double")).alias("fraction"))


def best_placement(placements: DataFrame) -> DataFrame:
    return placements.groupBy("query_id").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"), F.max("score").alias("score"))


def placement_accuracy(placements: DataFrame, truth: DataFrame, tolerance: int = 10, total: int | None = None) -> DataFrame:
    """The best placement against any of a read's true starts, over placed reads with a truth:
    (mapped, evaluated, correct, accuracy, unaligned, unaligned_fraction).

    truth: (query_id, lo, hi, read_length). Reads without a placement or a truth are no error;
    how many of ``total`` reads (all mapped ones by default) were not placed is told apart.
    """
    near = lambda c: F.abs(F.col("pos") - c) <= tolerance
    return _accuracy(placements, truth, near(F.col("lo")) | near(F.col("hi")) | near(F.col("hi") - F.col("read_length") + 1), total)


def _accuracy(placements: DataFrame, truth: DataFrame, ok: Column, total: int | None) -> DataFrame:
    j = best_placement(placements).join(truth.withColumn("__known", F.lit(True)), "query_id", "left")
    known = F.col("__known").isNotNull()
    a = j.agg(F.count("*").alias("mapped"), F.count(F.when(known, 1)).alias("evaluated"), F.count(F.when(known & ok, 1)).alias("correct"))
    of = F.lit(total).cast("bigint") if total else F.col("mapped")
    gone = F.greatest(of - F.col("mapped"), F.lit(0)).cast("bigint")
    return a.select("mapped", "evaluated", "correct", _share(F.col("correct"), F.col("evaluated")).alias("accuracy"), gone.alias("unaligned"), _share(gone, of).alias("unaligned_fraction"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def truth_from_names(reads: DataFrame) -> DataFrame:
    t = truth_of_name(F.col("id"))
    return reads.select(F.col("id").alias("query_id"), t["lo"].alias("lo"), t["hi"].alias("hi"), F.length("bases").alias("read_length")).filter("lo is not null")


def start_accuracy(placements: DataFrame, truth: DataFrame, tolerance: int = 3, total: int | None = None) -> DataFrame:
    """Against one true start, like `placement_accuracy`: truth (query_id, start). Only the first
    word of a placed name counts, as sequence headers may go on."""
    named = placements.withColumn("query_id", F.split(F.col("query_id").cast("string"), " ")[0])
    return _accuracy(named, truth.withColumn("query_id", F.col("query_id").cast("string")), F.abs(F.col("pos") - F.col("start")) <= tolerance, total)


def indel_concordance(alignments: DataFrame, truth: DataFrame) -> DataFrame:
    """(reads, concordant, iec) over reads with a true event: the CIGAR's runs of I and D must
    be as many as the events. alignments (query_id, cigar); truth (query_id, n_events)."""
    j = truth.filter("n_events > 0").join(alignments, "query_id", "left")
    ok = F.coalesce(F.regexp_count("cigar", F.lit("[ID]")) == F.col("n_events"), F.lit(False))
    return j.agg(F.count("*").alias("reads"), F.sum(ok.cast("bigint")).alias("concordant")).withColumn("iec", F.col("concordant") / F.col("reads"))


def replicates(runs: DataFrame, warn: float = 0.05, threads: int = 8, triad_gbps: float | None = None) -> DataFrame:
    """(target, reps, mean_wall, cv, noisy) of (target, wall): noisy where the deviation passes 5 %.

    Of the columns peak_rss_gb, unaligned_frac and total_reads those that ``runs`` has give
    peak_rss_gb (null where none is above 0), unaligned_frac (the mean of those above 0) and
    total_reads (the most); with the memory's triad rate, rnt: reads by wall, threads and rate.
    """
    has = set(runs.columns)
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    aggs = [F.count("*").alias("reps"), F.avg("wall").alias("mean_wall"), F.coalesce(F.stddev_samp("wall"), F.lit(0.0)).alias("sd")]
    if "peak_rss_gb" in has:
        aggs.append(F.when(F.max("peak_rss_gb") > 0, F.round(F.avg("peak_rss_gb"), 3)).alias("peak_rss_gb"))
    if "unaligned_frac" in has:
        aggs.append(F.round(F.avg(above("unaligned_frac")), 4).alias("unaligned_frac"))
    if "total_reads" in has:
        aggs.append(F.max("total_reads").alias("total_reads"))
    a = runs.groupBy("target").agg(*aggs)
    cv = F.coalesce(F.col("sd") / F.nullif(F.col("mean_wall"), F.lit(0.0)), F.lit(0.0))
    more = [c for c in ("peak_rss_gb", "unaligned_frac", "total_reads") if c in has]
    out = a.select("target", "reps", "mean_wall", cv.alias("cv"), (cv > warn).alias("noisy"), *more)
    if triad_gbps is not None and "total_reads" in has:
        out = out.withColumn("rnt", F.round(F.col("total_reads") / F.nullif(F.col("mean_wall") * threads * triad_gbps / 1000, F.lit(0.0)), 4))
    return out


def aligned_queries(placements: DataFrame) -> DataFrame:
    return placements.agg(F.countDistinct("query_id").alias("aligned"))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("reads"))
