"""Intervals, runs and sweeps over positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import quantize


#: Positions that one task sweeps by itself; what crosses a border is told by one row a border.
BIN = 1 << 20


def coverage_sweep(spans: DataFrame, ref: str = "ref_id", start: str = "start", end: str = "end", bin_size: int = BIN) -> DataFrame:
    """Half-open spans as runs of equal depth: (ref_id, start, end, depth), depth 0 left out.

    Ends become +1 and -1 events, summed per position before the running sum, so that the
    window sees each position once however deep the coverage.
    """
    ends = spans.select(F.col(ref).alias("ref_id"), F.inline(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))))
    return _sweep(ends, bin_size)


def _sweep(events: DataFrame, bin_size: int) -> DataFrame:
    """Running sums within bins of positions, on top of the sum of all bins before.

    A bin is a partition of the window, so that one long reference is the work of many tasks;
    only one row a bin (its sum and first position) goes through a window over the reference.
    """
    at = events.groupBy("ref_id", F.floor(F.col("pos") / bin_size).alias("bin"), "pos").agg(F.sum("d").alias("d"))
    bins = at.groupBy("ref_id", "bin").agg(F.sum("d").alias("sum"), F.min("pos").alias("first"))
    over = Window.partitionBy("ref_id").orderBy("bin")
    before = F.coalesce(F.sum("sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("ref_id", "bin", before.alias("before"), F.lead("first").over(over).alias("after"))
    w = Window.partitionBy("ref_id", "bin").orderBy("pos")
    runs = at.select("ref_id", "bin", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    whole = runs.join(bins, ["ref_id", "bin"]).select("ref_id", "start", F.coalesce("end", "after").alias("end"), (F.col("depth") + F.col("before")).cast("bigint").alias("depth"))
    return whole.filter("end is not null and depth <> 0")


def rle_encode(points: DataFrame, value: str = "value", bin_size: int = BIN) -> DataFrame:
    """(ref_id, start, length, value) of equal quantised neighbours; points: (ref_id, pos, value)."""
    q = points.select("ref_id", F.floor(F.col("pos") / bin_size).alias("bin"), F.col("pos").alias("start"), F.col("pos").alias("end"), quantize(F.col(value)).alias("value"))
    runs = _joined(q, ["ref_id"], ["value"], bin_size)
    return runs.select("ref_id", "start", (F.col("end") - F.col("start") + 1).cast("int").alias("length"), "value")


def _joined(parts: DataFrame, by: list[str], like: list[str], bin_size: int) -> DataFrame:
    """Inclusive (start, end) pieces with a bin, those that touch and are alike made one.

    First within bins, then among the pieces that touch a border of their bin: two a bin at most.
    """

    def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start") if keys else Window.orderBy("start")
        new = F.col("start") != F.lag("end").over(w) + 1
        for c in like:
            new = new | (F.col(c) != F.lag(c).over(w))
        marked = rows.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
        return marked.groupBy(*keys, *like, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")

    inside = islands(parts, [*by, "bin"])
    borders = (F.col("start") == F.col("bin") * bin_size) | (F.col("end") == (F.col("bin") + 1) * bin_size - 1)
    cols = [*by, "start", "end", *like]
    return inside.filter(~borders).select(*cols).unionByName(islands(inside.filter(borders).drop("bin"), by).select(*cols))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(ref_id, pos, value), one row a position."""
    each = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    return runs.filter("length > 0").select("ref_id", each.alias("pos"), "value")


def coverage_at(runs: DataFrame, points: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Points (ref_id, pos, ...) with the value of the run that holds them; null outside of all.

    Runs: (ref_id, start, length, value) without overlap. Both sides meet by bins of positions.
    """
    end = F.col("start") + F.col("length")
    bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor((end - 1) / bin_size))
    cut = runs.filter("length > 0").select(F.col("ref_id").alias("__ref"), F.col("start").alias("__start"), end.alias("__end"), F.col("value"), F.explode(bins).alias("__bin"))
    on = (F.col("ref_id") == F.col("__ref")) & (F.floor(F.col("pos") / bin_size) == F.col("__bin")) & (F.col("pos") >= F.col("__start")) & (F.col("pos") < F.col("__end"))
    return points.drop("value").join(cut, on, "left").drop("__ref", "__start", "__end", "__bin")


def merge_coverage(runs: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Sums the runs of all samples and quantises the sums: (ref_id, start, end, value)."""
    end = F.col("start") + F.col("length")
    events = runs.select("ref_id", F.inline(F.array(F.struct(F.col("start").alias("pos"), F.col("value").cast("bigint").alias("d")), F.struct(end.alias("pos"), (-F.col("value").cast("bigint")).alias("d")))))
    return _sweep(events, bin_size).select("ref_id", "start", "end", quantize(F.col("depth")).alias("value"))


def hotspots(scores: DataFrame, threshold: float = 0.5, pos: str = "pos", score: str = "score", bin_size: int = BIN) -> DataFrame:
    """Inclusive (start, end) islands of neighbouring positions whose score is below the threshold."""
    low = scores.filter(F.col(score) < threshold).select(F.col(pos).cast("bigint").alias("start")).distinct()
    return _joined(low.select(F.floor(F.col("start") / bin_size).alias("bin"), "start", F.col("start").alias("end")), [], [], bin_size).select("start", "end")


def in_interval(points: DataFrame, intervals: DataFrame, out: str, bin_size: int = 4096, pos: str = "pos") -> DataFrame:
    """Adds ``out``: whether start <= pos < end for some interval, half-open as its users test it.

    Both sides are cut into bins of positions, so that the range join is an equi-join; a long
    interval stands in each of its bins.
    """
    bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))
    cut = intervals.filter("end > start").select("start", "end", F.explode(bins).alias("__bin"))
    binned = points.withColumn("__bin", F.floor(F.col(pos) / bin_size))
    hit = binned.select("__bin", F.col(pos).alias("__pos")).distinct().join(cut, "__bin").filter("__pos >= start and __pos < end").select("__pos").distinct().withColumn(out, F.lit(True))
    return points.join(hit, F.col(pos) == F.col("__pos"), "left").drop("__pos").withColumn(out, F.coalesce(out, F.lit(False)))


#: Units of four, then three, then two bases, three times or more.
_REPEATS = re.compile(r"(.{4})\1{2,}|(.{3})\2{2,}|(.{2})\3{2,}", re.S)


def find_repeats(bases: str | None) -> list[tuple[int, int, int, str]]:
    """(start, end, period, unit), ends inclusive, left to right without overlap."""
    out = []
    for m in _REPEATS.finditer((bases or "").upper()):
        unit = m[1] or m[2] or m[3]
        out.append((m.start(), m.end() - 1, len(unit), unit))
    return out


def tandem_repeats(seqs: DataFrame) -> DataFrame:
    """(seq_id, start, end, period, unit) of sequences (id, bases)."""
    schema = "seq_id string, start int, end int, period int, unit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in find_repeats(s)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["seq_id", "start", "end", "period", "unit"])

    return seqs.select(F.col("id").cast("string"), "bases").mapInArrow(run, schema)
