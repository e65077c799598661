"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a rate: the mean number of copies of its rows that brings it to its share
of the mix. A row's count inverts the Poisson distribution at a uniform number hashed from
seed and id, so that it does not depend on partitioning. Rows are exploded by their count
and put in the order of a hash of seed, id and copy: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, shuffle_parts

#: Up to so many sources the rates are sent to all tasks (under 1 MB); more are joined.
MAX_BROADCAST_SOURCES = 10_000
SALT = 64


def uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 13 hex digits of an md5; the same in other engines."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, epochs: float, flatten: float) -> DataFrame:
    """(source, rate): rate = share * epochs * all rows / the source's rows.

    Shares are ``weights`` over their sum; without weights, rows ** flatten over their sum.
    Sources that the weights do not name get rate 0. Null is a source of its own, named ''.
    """
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        counts = counts.withColumn("w", F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(0.0)))
    else:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(flatten)))
    totals = counts.agg(F.sum("n").alias("whole"), F.sum("w").alias("sum"))
    rate = F.col("w") / F.col("sum") * F.lit(float(epochs)) * F.col("whole") / F.col("n")
    # one row beside one row per source
    return counts.join(F.broadcast(totals)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k with cdf(k) >= u, by summing terms while their sum is below u.

    For rates past 600, where exp(-rate) vanishes, the count is rate split into equal parts
    of at most 600 whose counts invert hashed parts of u (sums of Poissons are Poisson).
    """
    parts = F.greatest(F.ceil(rate / 600.0), F.lit(1)).cast("int")
    share = rate / parts

    def one(v: Column) -> Column:
        # k terms suffice: mean + 12 deviations + 30 lie past any u below 1 - 2**-53
        most = F.ceil(share + F.sqrt(share) * 12.0 + 30.0).cast("int")
        start = F.struct(F.exp(-share).alias("term"), F.exp(-share).alias("cdf"), F.lit(0).alias("n"))

        def step(a: Column, k: Column) -> Column:
            term = a["term"] * share / k
            return F.struct(term.alias("term"), (a["cdf"] + term).alias("cdf"), (a["n"] + F.when(a["cdf"] < v, 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["n"])

    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + one(F.when(parts == 1, u).otherwise(uniform(u, i))))
    return F.when(rate <= 0, F.lit(0)).otherwise(many)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    source: str = "source",
    key: str = "doc_id",
    epochs: float = 1.0,
    flatten: float = 0.5,
    seed: int = 11,
    copy: str = "copy",
    position: str = "position",
) -> DataFrame:
    """Rows of ``docs`` times their Poisson counts, with copy (from 0) and position (0 to 1).

    The result is ordered globally by position: partition i of n holds the positions from i/n
    to (i+1)/n, in order. Rows that share a key share a count. A null key draws as the text ''
    does, a null source is a source. An empty table gives an empty one. Columns named ``copy``
    and ``position`` are replaced, all others stay, whatever their names. No row is collected;
    a hot source is no key of any exchange but that of the counts, which are summed before it.
    """
    docs = docs.drop(copy, position)
    own = _fresh(docs.columns, "source", "rate", "n", "slot")
    rate = rates(docs, source, weights, epochs, flatten).toDF(own["source"], own["rate"])
    dealt = docs.withColumn(own["source"], F.coalesce(F.col(source), F.lit("")))
    if rate.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        dealt = dealt.join(F.broadcast(rate), own["source"])
    else:
        slot = F.coalesce(F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"), F.lit(0))
        spread = rate.withColumn(own["slot"], F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        dealt = dealt.withColumn(own["slot"], slot).join(spread, [own["source"], own["slot"]])
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    count = poisson_count(uniform(F.lit(seed), F.lit("count"), name), F.col(own["rate"]))
    out = dealt.withColumn(own["n"], count).filter(F.col(own["n"]) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(own["n"]) - 1)))
    out = out.withColumn(position, uniform(F.lit(seed), F.lit("place"), name, F.col(copy)))
    # positions are uniform, so that equal ranges hold equal shares and no sample is needed
    parts = shuffle_parts(docs.sparkSession)
    place = F.least(F.floor(F.col(position) * parts).cast("int"), F.lit(parts - 1))
    return out.select(*map(named, [*docs.columns, copy, position])).repartitionById(parts, place).sortWithinPartitions(position)


def _fresh(taken: list[str], *names: str) -> dict[str, str]:
    """A name for each use that no column has, in any case."""
    taken = {c.lower() for c in taken}
    out = {}
    for n in names:
        made = f"__{n}"
        while made in taken:
            made += "_"
        out[n] = made
    return out


#: The query's result in DuckDB, for rates up to 600 (one part).
SQL = """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
r AS (SELECT s, w / (SELECT sum(w) FROM n) * 1.0 * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
p AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM r
  UNION ALL SELECT s, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM p
  WHERE k < ceil(rate + sqrt(rate) * 12 + 30)),
c AS (SELECT s, list(cdf ORDER BY k) AS cdfs FROM p GROUP BY s),
u AS (
  SELECT d.*, (('0x' || substr(md5('11|count|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d),
t AS (SELECT u.* EXCLUDE (u), len(list_filter(cdfs, lambda x: x < u.u)) AS cnt FROM u JOIN c ON coalesce(u.source, '') = c.s),
e AS (SELECT t.* EXCLUDE (cnt), unnest(generate_series(0, cnt - 1)) AS copy FROM t WHERE cnt > 0)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
  (('0x' || substr(md5('11|place|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS position
FROM e
"""
