"""Exact top-k search with vector-approximation files.

Vectors become integers, floor(scale * x). Two files are made of them: the exact vectors, one
row each under a key, and approximations, blocks of one byte a component, the cell its integer
lies in. A query first scans the approximations alone, which bound each score from both sides:
what can't reach the kth best lower bound is out. Only then are the exact vectors of the others
read, by key, in the order of their upper bounds, until the kth best score reaches the next one.

Queries are dealt to approximations block by block. Vectors whose integers are large have no
cells: doubles with a bound of their error take their part, and Python integers give the scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors of a candidate block and of a query block, and bytes a block may hold.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 2048, 512, 1 << 20
CELLS = 256
#: Integers past this are wide; below it scores of 2**20 components fit 64 bits.
LARGEST = 1 << 21

BLOCKS = "slot int, dim int, n int, keys binary, ids binary, data binary, low binary, width binary"


def _cells(x: np.ndarray) -> dict:
    """Per component equal cells from the block's least value on, as many as fit a byte."""
    low = x.min(axis=0)
    width = np.maximum(1, -(-(x.max(axis=0) - low + 1) // CELLS))
    return {"data": ((x - low) // width).astype(np.uint8).tobytes(), "low": low.tobytes(), "width": width.tobytes()}


def _integers(raw: bytes, dim: int, n: int, scale: float) -> np.ndarray:
    """Python integers of a block of doubles."""
    out = np.empty(dim * n, object)
    for j, v in enumerate(np.frombuffer(raw, np.float64).tolist()):
        y = scale * v
        out[j] = math.floor(y) if math.isfinite(y) else math.floor(Fraction(v) * Fraction(scale))
    return out.reshape(n, dim)


def stored(vectors: DataFrame, scale: float, id_: str, vector: str) -> DataFrame:
    """The exact file: (key, id, vector, dim, wide) of the vectors that take part, kept as it is.

    Null ids or vectors, and vectors with null or non-finite components take no part; empty
    ones do. wide: some integer reaches LARGEST.
    """
    rows = vectors.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("vector")).filter("id is not null and vector is not null")
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    wide = F.exists("vector", lambda x: F.abs(x.cast("double")) >= LARGEST / scale)
    rows = rows.filter(F.forall("vector", lambda x: plain(x.cast("double"))))
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("key"), "id", "vector", F.size("vector").alias("dim"), wide.alias("wide")))


def blocks(rows: DataFrame, block: int, scale: float, exact: bool) -> DataFrame:
    """Packs rows of `stored` into blocks of one dimension each. Narrow: a block is part of a
    partition. exact: their doubles; else the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            keys, ids, xs = held.pop(dim)
            x = np.array(xs, np.float64).reshape(len(xs), dim)
            row = {"data": x.tobytes(), "low": b"", "width": b""} if exact else _cells(np.floor(scale * x).astype(np.int64))
            row |= {"slot": keys[0] & 0x7FFFFFFF, "dim": dim, "n": len(ids), "keys": np.array(keys, np.int64).tobytes(), "ids": np.array(ids, np.int64).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for key, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                keys, ids, xs = held.setdefault(len(x), ([], [], []))
                keys.append(key)
                ids.append(i)
                xs.append(x)
                if len(ids) >= max(1, min(block, BLOCK_BYTES // (4 * max(1, len(x))))):
                    yield flush(len(x))
        for dim in sorted(held):
            yield flush(dim)

    arrow = pa.schema([("slot", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "data", "low", "width"))])
    return rows.select("key", "id", "vector").mapInArrow(run, BLOCKS)


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the least and the greatest score of each query and candidate, from cells alone.

    A component adds between q * lower edge and q * upper edge of its cell. Cells are equal,
    so that a query's table of them is a straight line in the cell's number, and looking all up
    is one product with the cells. All numbers are integers held exactly, doubles below 2**53.
    """
    most = float(np.abs(q).max(initial=0)) * float(np.abs(low).max(initial=0) + width.max(initial=0) * CELLS) * q.shape[1]
    kind = np.float64 if 4 * most < 2**53 else np.int64
    q, cells = q.astype(kind), cells.astype(kind)
    middle = (2 * q * width.astype(kind)) @ cells.T + (q @ (2 * low + width - 1).astype(kind))[:, None]
    slack = (np.abs(q) @ (width - 1).astype(kind))[:, None]
    return middle - slack, middle + slack


def survivors(least: np.ndarray, most: np.ndarray, own: np.ndarray, k: int, best: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates of a block each query must read, and its k best lower bounds so far.

    own: whether the candidate is the query itself. best: those bounds of the blocks before.
    """
    least = np.where(own, -np.inf, least)
    if least.shape[1] > k:
        least = np.partition(least, least.shape[1] - k, axis=1)[:, -k:]
    best = least if best is None else np.concatenate([best, least], axis=1)
    best = np.sort(best, axis=1)[:, -k:]
    kth = best[:, 0] if best.shape[1] == k else np.full(len(best), -np.inf)
    return (most >= kth[:, None]) & ~own, best


def wide_top_k(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, place in the block, score) of each query's best k, ties to smaller ids.

    Doubles score all candidates to within dim + 4 roundings of the sum of absolute products;
    those that may be among the best k are scored exactly.
    """
    bits = max((int(v).bit_length() for side in (x, q) for v in side.flat), default=0)
    out = []
    if bits < 400:
        xf, qf = x.astype(np.float64), q.astype(np.float64)
        about, slack = qf @ xf.T, (np.abs(qf) @ np.abs(xf).T) * ((q.shape[1] + 4) * 2.0**-51)
    for r in range(len(q)):
        own = np.flatnonzero(ids != qid[r])
        if bits < 400 and len(own) > k:
            least = np.sort((about[r] - slack[r])[own])[-k]
            own = own[(about[r] + slack[r])[own] >= least]
        row = q[r].tolist()
        best = sorted((-sum(a * b for a, b in zip(row, x[c].tolist(), strict=True)), int(ids[c]), int(c)) for c in own)[:k]
        out += [(int(qid[r]), c, -s) for s, _, c in best]
    return out


def _ordered(score: int) -> tuple[int, int | None, bytes | None]:
    """(side, score, past): in this order they sort like the score. past holds one of over 64 bits."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, None
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (1, None, raw) if score > 0 else (-1, None, bytes(255 - b for b in raw))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, *, scale: float = 256.0, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, exactly.

    A candidate of the query's own id is left out; vectors of other dimensions do not meet.
    Queries with no candidate have no rows; neither have empty tables. Rows that repeat an id
    are candidates each, ranked by ties like others. Ranks are exact for any finite vectors; a
    score of over 64 bits is null. Other columns are not read.
    Memory per task: one block of either side and k bounds a query. Query blocks are copied to
    every slot of candidate blocks; a slot holds a few blocks, and no group is gathered.
    """
    c, q = stored(candidates, scale, id_, vector), stored(queries, scale, id_, vector)
    narrow = _scanned(q.filter("not wide"), c.filter("not wide"), k, scale)
    found = _read(narrow, q, c, k, scale)
    some = lambda df: df.filter("wide").limit(1).count() > 0
    if some(c):
        found = found.unionByName(_wide(q, c.filter("wide"), k, scale))
    if some(q):
        found = found.unionByName(_wide(q.filter("wide"), c.filter("not wide"), k, scale))
    # rows that repeat a query's id and vector are one query
    found = found.distinct()
    w = Window.partitionBy("query_id").orderBy(F.col("side").desc(), F.col("score").desc(), F.col("past").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _met(q: DataFrame, c: DataFrame) -> DataFrame:
    """Every query block beside every candidate block of its dimension, by slots of the latter."""
    spark = c.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    c = c.withColumn("slot", F.pmod(F.xxhash64("slot", "keys"), F.lit(slots)).cast("int"))
    q = q.select(F.col("dim").alias("q_dim"), F.col("keys").alias("q_keys"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    q = q.withColumn("q_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    pairs = c.join(q, (F.col("slot") == F.col("q_slot")) & (F.col("dim") == F.col("q_dim")))
    return pairs.select("dim", "keys", "ids", "data", "low", "width", "q_keys", "q_ids", "q_data")


_SURVIVORS = "q_key bigint, query_id bigint, c_key bigint, vec_id bigint, least double, most double"


def _scanned(q: DataFrame, c: DataFrame, k: int, scale: float) -> DataFrame:
    """Pairs whose upper bound reaches the kth best lower bound of the query, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}
        for b in batches:
            for at in range(b.num_rows):
                dim, keys, ids, cells, low, width, q_keys, q_ids, q_data = (col[at].as_py() for col in b.columns)
                get = lambda raw, t=np.int64: np.frombuffer(raw, t)
                x = np.floor(scale * get(q_data, np.float64).reshape(-1, dim)) if dim else np.zeros((len(q_keys) // 8, 0))
                cells = get(cells, np.uint8).reshape(len(keys) // 8, dim)
                least, most = bounds(x.astype(np.int64), cells, get(low), get(width))
                own = get(q_ids)[:, None] == get(ids)[None, :]
                keep, now = survivors(least, most, own, k, best.get(q_keys))
                best[q_keys] = now
                i, j = np.nonzero(keep)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (get(q_keys)[i], get(q_ids)[i], get(keys)[j], get(ids)[j], least[i, j].astype(np.float64), most[i, j].astype(np.float64))], names=[n.split()[0] for n in _SURVIVORS.split(", ")])

    pairs = _met(blocks(q, QUERY_BLOCK, scale, True), blocks(c, BLOCK, scale, False)).mapInArrow(run, _SURVIVORS)
    w = Window.partitionBy("q_key").orderBy(F.col("least").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth = F.nth_value("least", k).over(w)
    # past 2**53 a double may be off by one in 2**53 of its value
    slack = F.abs("most") * 2.0**-51
    return pairs.withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("most") + slack >= F.col("kth") - F.abs("kth") * 2.0**-51)).drop("kth", "least")


_FOUND = "query_id bigint, c_key bigint, vec_id bigint, side int, score bigint, past binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n.split()[0] for n in _FOUND.split(", ")])


def _read(pairs: DataFrame, q: DataFrame, c: DataFrame, k: int, scale: float) -> DataFrame:
    """Exact scores of the pairs, each query's in the order of the upper bounds until k are certain."""
    exact = lambda df, key, as_: df.select(F.col("key").alias(key), F.col("vector").alias(as_))
    rows = pairs.join(exact(c, "c_key", "c_vector"), "c_key").join(exact(q, "q_key", "q_vector"), "q_key")
    rows = rows.select("q_key", "query_id", "c_key", "vec_id", "most", "q_vector", "c_vector").repartition("q_key").sortWithinPartitions("q_key", F.col("most").desc(), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, top = None, None, []
        integers = lambda v: np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        for b in batches:
            out = []
            plain = [b.column(i).to_pylist() for i in range(5)]
            for at, (q_key, query, c_key, vec, most) in enumerate(zip(*plain, strict=True)):
                if q_key != now:
                    now, x, top = q_key, integers(b.column(5)[at]), []
                # bounds are doubled; a tie may still win by its id
                if len(top) == k and most * (1 + 2.0**-50 * (1 if most > 0 else -1)) < 2 * top[0]:
                    continue
                score = int(x @ integers(b.column(6)[at]))
                if len(top) < k:
                    heapq.heappush(top, score)
                elif score > top[0]:
                    heapq.heapreplace(top, score)
                out.append((query, c_key, vec, 0, score, None))
            if out:
                yield _found(out)

    return rows.mapInArrow(run, _FOUND)


def _wide(q: DataFrame, c: DataFrame, k: int, scale: float) -> DataFrame:
    """The best k of each query in each block, from exact vectors, where either side is wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                dim, keys, ids, data, _, _, q_keys, q_ids, q_data = (col[at].as_py() for col in b.columns)
                keys, ids, q_ids = (np.frombuffer(v, np.int64) for v in (keys, ids, q_ids))
                rows = wide_top_k(_integers(q_data, dim, len(q_ids), scale), q_ids, _integers(data, dim, len(ids), scale), ids, k)
                if rows:
                    yield _found([(query, int(keys[j]), int(ids[j]), *_ordered(s)) for query, j, s in rows])

    return _met(blocks(q, QUERY_BLOCK, scale, True), blocks(c, BLOCK, scale, True)).mapInArrow(run, _FOUND)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e, len(embedding) AS dim
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
