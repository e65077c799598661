"""Seeded sequences, reads and proteins with their truth, as DataFrames from spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _draw(n: int, *parts: Column) -> Column:
    """A number below n, hashed from its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(n)).cast("int")


def letters(length: Column, alphabet: str, *parts: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.substr(F.lit(alphabet), _draw(len(alphabet), *parts, i) + 1, F.lit(1)))
    return F.array_join(each, "")


def reference(spark: SparkSession, length: int, seed: int = 1, name: str = "ref") -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("id"), letters(F.lit(length), "ACGT", F.lit(seed)).alias("bases"))


def mutated(true: Column, alphabet: str, divergence: float, indel_rate: float, indel_max: int, *parts: Column) -> Column:
    """struct<text, n_subs, indel_events> of a fragment. At each of its places one thing happens at
    most: an insertion before it or a deletion from it on, of 1 to ``indel_max`` letters, or a
    substitution. Events are told as ``offset:op:length;...`` in places of the fragment."""
    chance = lambda kind, i: _draw(1_000_000, *parts, F.lit(kind), i)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("skip"), F.lit(0).alias("subs"), F.lit("").alias("events"))

    def step(a: Column, i: Column) -> Column:
        old = F.substr(true, i + 1, F.lit(1))
        others = F.replace(F.lit(alphabet), old, F.lit(""))
        other = F.substr(others, _draw(len(alphabet) - 1, *parts, F.lit("to"), i) + 1, F.lit(1))
        gone, indel = i < a["skip"], chance("indel", i) < int(indel_rate * 1_000_000)
        size = _draw(indel_max, *parts, F.lit("size"), i) + 1
        grows = _draw(2, *parts, F.lit("kind"), i) == 0
        cut = F.least(size, F.length(true) - i)
        event = lambda op, n: F.concat(a["events"], i.cast("string"), F.lit(f":{op}:"), n.cast("string"), F.lit(";"))
        new = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda k: F.substr(F.lit(alphabet), _draw(len(alphabet), *parts, F.lit("new"), i, k) + 1, F.lit(1))), "")
        state = lambda text, skip, subs, events: F.struct(text.alias("text"), skip.alias("skip"), subs.alias("subs"), events.alias("events"))
        sub = chance("sub", i) < int(divergence * 1_000_000)
        return (
            F.when(gone, a)
            .when(indel & grows, state(F.concat(a["text"], new, old), a["skip"], a["subs"], event("I", size)))
            .when(indel, state(a["text"], i + cut, a["subs"], event("D", cut)))
            .when(sub, state(F.concat(a["text"], other), a["skip"], a["subs"] + 1, a["events"]))
            .otherwise(state(F.concat(a["text"], old), a["skip"], a["subs"], a["events"]))
        )

    return F.aggregate(F.sequence(F.lit(0), F.length(true) - 1), start, step, lambda a: F.struct(a["text"].alias("text"), a["subs"].alias("n_subs"), a["events"].alias("indel_events")))


def reads(ref: DataFrame, n: int, length: int = 150, divergence: float = 0.01, seed: int = 1, indel_rate: float = 0.0, indel_max: int = 4) -> DataFrame:
    """(id, bases, start, strand, n_subs, indel_events): reads of a reference of one row, both
    strands; offsets of events are those of the forward fragment."""
    spark = ref.sparkSession
    base = spark.range(n).join(F.broadcast(ref.select(F.col("bases").alias("ref"))))
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "id"), F.length("ref") - length + 1).cast("int")
    cut = base.select("id", start.alias("start"), F.substr("ref", start + 1, F.lit(length)).alias("true"), F.when(_draw(2, F.lit(seed), F.lit("strand"), F.col("id")) == 0, "+").otherwise("-").alias("strand"))
    made = cut.withColumn("m", mutated(F.col("true"), "ACGT", divergence, indel_rate, indel_max, F.lit(seed), F.col("id")))
    flipped = F.reverse(F.translate("m.text", "ACGT", "TGCA"))
    return made.select(F.concat(F.lit("read"), F.col("id").cast("string")).alias("id"), F.when(F.col("strand") == "-", flipped).otherwise(F.col("m.text")).alias("bases"), "start", "strand", "m.n_subs", "m.indel_events")


AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def protein_queries(proteins: DataFrame, n: int, length: int = 100, divergence: float = 0.05, seed: int = 1, indel_rate: float = 0.0, indel_max: int = 4) -> DataFrame:
    """(id, bases, source_protein, start, n_subs, indel_events): mutated pieces of proteins
    (id, bases), each of ``n`` pieces of the protein that its number falls on; one orientation."""
    m = proteins.count()
    numbered = proteins.select(F.col("id").alias("source_protein"), F.col("bases").alias("ref"), (F.row_number().over(Window.orderBy("id")) - 1).cast("bigint").alias("__p"))
    drawn = proteins.sparkSession.range(n).withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), F.lit("protein"), "id"), F.lit(max(1, m))))
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "id"), F.greatest(F.length("ref") - length + 1, F.lit(1))).cast("int")
    cut = drawn.join(numbered, "__p").select("id", "source_protein", start.alias("start"), F.substr("ref", start + 1, F.lit(length)).alias("true"))
    made = cut.withColumn("m", mutated(F.col("true"), AMINO_ACIDS, divergence, indel_rate, indel_max, F.lit(seed), F.col("id")))
    return made.select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("id"), F.col("m.text").alias("bases"), "source_protein", "start", "m.n_subs", "m.indel_events")


def proteome(spark: SparkSession, n: int, mean_length: int = 300, seed: int = 1) -> DataFrame:
    """(id, bases): proteins whose lengths lie within 30 % of the mean; no reverse strand."""
    jitter = _draw(601, F.lit(seed), F.lit("len"), F.col("id")) - 300
    length = (F.lit(mean_length) + F.lit(mean_length) * jitter / 1000).cast("int")
    return spark.range(n).select(F.concat(F.lit("prot"), F.col("id").cast("string")).alias("id"), letters(length, AMINO_ACIDS, F.lit(seed), F.col("id")).alias("bases"))
