"""Minimizer sketches and what is computed from them: joins, similarity, uniqueness.

A sketch is kept in long form (seq_id, hash, pos). It is made inside each row, in numpy over
Arrow batches (array functions of the JVM were measured at 40 times its time); no exchange is
needed before the join on hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: K-mer length and window of each alphabet; the dense window.
DEFAULTS = {"dna": (21, 11), "protein": (6, 5)}
DENSE_WINDOW = 5


_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _poly(raw: bytes, k: int) -> np.ndarray:
    """64-bit hashes of all k-mers, by k vector steps."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + b[j : j + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= _SPREAD
    return h ^ (h >> np.uint64(32))


#: The constants of MD5 (RFC 1321): sines, and rotations of its four rounds.
_SINES = np.array([int(abs(sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def md5_rows(rows: np.ndarray) -> np.ndarray:
    """MD5 of each row of bytes, up to 55 of them, as four little-endian words: one block each,
    all rows at once."""
    n, size = rows.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, :size] = rows
    block[:, size] = 0x80
    block[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
    words = np.ascontiguousarray(block.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[at]
        turn = np.uint32(_TURNS[i // 16][i % 4])
        a, d, c, b = d, c, b, b + (f << turn | f >> (np.uint32(32) - turn))
    return np.stack([x + s for x, s in zip((a, b, c, d), start, strict=True)], axis=1)


def _md5_ranks(raw: bytes, other: bytes, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each k-mer, or of the lesser of it and its complement: the digest, and a number that
    orders k-mers as their digests do."""
    mers = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), k)
    if canonical:
        twins = np.lib.stride_tricks.sliding_window_view(np.frombuffer(other, np.uint8), k)[::-1]
        first = (mers != twins).argmax(axis=1)[:, None]
        less = np.take_along_axis(twins, first, 1) < np.take_along_axis(mers, first, 1)
        mers = np.where(less, twins, mers)
    digests = np.concatenate([md5_rows(mers[i : i + 65_536]) for i in range(0, len(mers), 65_536)])
    halves = np.ascontiguousarray(digests).view(np.uint8).view(">u8").reshape(-1, 2).astype(np.uint64)
    rank, order = halves[:, 0], np.argsort(halves[:, 0], kind="stable")
    same = rank[order[1:]] == rank[order[:-1]]
    if (same & (halves[order[1:], 1] != halves[order[:-1], 1])).any():
        # two digests that differ in their second half alone
        rank = np.unique(halves, axis=0, return_inverse=True)[1].ravel()
    return digests, rank


def minimizers(bases: str, k: int, w: int, canonical: bool = True, order: str = "poly") -> tuple[list, np.ndarray]:
    """Hashes and 0-based positions of the least k-mers of all full windows of w k-mers.

    A k-mer and its reverse complement rank alike where canonical. Equal hashes yield to the
    smaller position. A sequence shorter than one window has none. order: poly, a 64-bit hash,
    or md5 in hexadecimal, which other engines have too.
    """
    raw = bases.encode()
    n = len(raw) - k + 1
    if n < w:
        return [], np.empty(0, np.int32)
    other = raw.translate(_COMPLEMENT)[::-1]
    if order == "md5":
        digests, rank = _md5_ranks(raw, other, k, canonical)
    else:
        rank = _poly(raw, k)
        if canonical:
            rank = np.minimum(rank, _poly(other, k)[::-1])
    windows = np.lib.stride_tricks.sliding_window_view(rank, w)
    pos = np.unique(windows.argmin(axis=1) + np.arange(n - w + 1)).astype(np.int32)
    if order == "md5":
        text = digests[pos].tobytes().hex()
        return [text[i : i + 32] for i in range(0, len(text), 32)], pos
    return rank[pos].view(np.int64).tolist(), pos


def sketch(seqs: DataFrame, k: int | None = None, w: int | None = None, alphabet: str = "dna", order: str = "poly", floor: int | None = None) -> DataFrame:
    """(seq_id, hash, pos) of sequences (id, bases), with an alphabet's defaults. Narrow.

    floor: leaves out what occurrence_cap of that floor does, row by row; ids are taken to be
    unique.
    """
    dk, dw = DEFAULTS[alphabet]
    k, w = k or dk, w or dw
    if alphabet == "dna" and (w + k - 1) % 2 == 0:
        raise ValueError("k + w - 1 must be odd, or a window has no middle k-mer")
    schema = T.StructType([T.StructField("seq_id", seqs.schema["id"].dataType), T.StructField("hash", T.StringType() if order == "md5" else T.LongType()), T.StructField("pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, places, rows = [], [], []
            for i, v in enumerate(b.column(1)):
                h, p = minimizers(v.as_py(), k, w, alphabet == "dna", order)
                if floor is not None and len(h) > floor:
                    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
                    rare = n[which] <= max(floor, 8 * np.sort(n)[len(n) // 2])
                    h, p = [x for x, r in zip(h, rare, strict=True) if r], p[rare]
                hashes += h
                places.append(p)
                rows.append(np.full(len(p), i))
            if rows:
                at = pa.array(np.concatenate(rows), pa.int64())
                kind = pa.string() if order == "md5" else pa.int64()
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(hashes, kind), pa.array(np.concatenate(places), pa.int32())], names=["seq_id", "hash", "pos"])

    return seqs.filter(F.length("bases") >= k + w - 1).select("id", "bases").mapInArrow(run, schema)


def deduplicate(sketches: DataFrame) -> DataFrame:
    return sketches.dropDuplicates(["seq_id", "hash", "pos"])


def dense_membership(seqs: DataFrame, alphabet: str = "dna", order: str = "poly") -> DataFrame:
    """The dense sketch with a flag for what the default window selects as well."""
    dense = sketch(seqs, w=DENSE_WINDOW, alphabet=alphabet, order=order)
    usual = sketch(seqs, alphabet=alphabet, order=order).withColumn("usual", F.lit(True))
    return dense.join(usual, ["seq_id", "hash", "pos"], "left").withColumn("usual", F.coalesce("usual", F.lit(False)))


def occurrence_cap(target: DataFrame, floor: int = 256) -> DataFrame:
    """(target_id, cap): the larger of the floor and 8 times the upper median of how often
    the target's hashes occur. The median comes from counts of counts, not from all hashes."""
    n = target.groupBy(F.col("seq_id").alias("target_id"), "hash").agg(F.count("*").alias("occ"))
    levels = n.groupBy("target_id", "occ").agg(F.count("*").alias("many"))
    w = Window.partitionBy("target_id").orderBy("occ")
    whole = Window.partitionBy("target_id")
    placed = levels.withColumn("upto", F.sum("many").over(w)).withColumn("half", F.floor(F.sum("many").over(whole) / 2))
    median = placed.filter("upto > half").groupBy("target_id").agg(F.min("occ").alias("median"))
    return median.select("target_id", F.greatest(F.lit(floor), F.col("median") * 8).cast("bigint").alias("cap"))


def find_seeds(query: DataFrame, target: DataFrame, capped: bool = True, floor: int = 256) -> DataFrame:
    """Equal hashes of two sketches: (query_id, target_id, query_pos, target_pos, hash).

    Hashes of a target that occur more often than its cap are left out before the join, which
    is what keeps low-complexity targets from pairing with everything. Where each target is one
    row, `seeds_of` finds its cap while it is sketched, without the exchanges needed here.
    """
    t = target.select(F.col("seq_id").alias("target_id"), "hash", F.col("pos").alias("target_pos"))
    if capped:
        n = t.groupBy("target_id", "hash").agg(F.count("*").alias("occ"))
        rare = n.join(occurrence_cap(target, floor), "target_id").filter("occ <= cap").select("target_id", "hash")
        t = t.join(rare, ["target_id", "hash"])
    q = query.select(F.col("seq_id").alias("query_id"), "hash", F.col("pos").alias("query_pos"))
    return q.join(t, "hash").select("query_id", "target_id", "query_pos", "target_pos", "hash")


def seeds_of(queries: DataFrame, targets: DataFrame, alphabet: str = "dna", order: str = "poly", floor: int | None = 256) -> DataFrame:
    """`find_seeds` of two tables of sequences (id, bases), each sketched once. Target ids are
    unique; floor: the cap's least value, or None for no cap."""
    t = sketch(targets, alphabet=alphabet, order=order, floor=floor)
    return find_seeds(sketch(queries, alphabet=alphabet, order=order), t, capped=False)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, common): distinct hashes that two sketches share, for pairs that share any."""
    x = a.select(F.col("seq_id").alias("id_a"), "hash").distinct()
    y = b.select(F.col("seq_id").alias("id_b"), "hash").distinct()
    return x.join(y, "hash").groupBy("id_a", "id_b").agg(F.count("*").alias("common"))


def jaccard_of(common: Column, n_a: Column, n_b: Column) -> Column:
    """|a & b| / |a | b|; 1 for two empty sketches."""
    return F.coalesce(common / F.nullif(n_a + n_b - common, F.lit(0)), F.lit(1.0))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, common, jaccard) for pairs that share a hash, over sets of hashes.

    Pairs that share none have 0 and are not listed; `jaccard_all` lists every pair of given
    ids, and gives two empty sketches 1.
    """
    common, n_a, n_b = shared(a, b), _sizes(a, "id_a", "n_a"), _sizes(b, "id_b", "n_b")
    return common.join(n_a, "id_a").join(n_b, "id_b").select("id_a", "id_b", "common", jaccard_of(F.col("common"), F.col("n_a"), F.col("n_b")).alias("jaccard"))


def _sizes(sketches: DataFrame, key: str, n: str) -> DataFrame:
    return sketches.select(F.col("seq_id").alias(key), "hash").distinct().groupBy(key).agg(F.count("*").alias(n))


def jaccard_all(sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chosen pairs (id_a, id_b) with common and jaccard, those without a common hash and empty
    sketches among them."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = pairs.join(_sizes(sketches, "id_a", "n_a"), "id_a", "left").join(_sizes(sketches, "id_b", "n_b"), "id_b", "left").join(shared(sketches, sketches), ["id_a", "id_b"], "left")
    return j.select("id_a", "id_b", none("common").alias("common"), jaccard_of(none("common"), none("n_a"), none("n_b")).alias("jaccard"))


def select_centroid(sketches: DataFrame, items: DataFrame) -> DataFrame:
    """The item whose median similarity to the others stands in the middle of all items.

    items: (id, idx) in input order. One row (id, idx, median), none for no items. Only pairs
    that share a hash are listed; the others count as 0 by their number, so that no table of
    all pairs is made. Two items without a hash count as 0 too.
    """
    n = items.count()
    if not n:
        return items.select("id", "idx", F.lit(0.0).alias("median"))
    listed = jaccard(sketches, sketches).filter("id_a <> id_b").select(F.col("id_a").alias("id"), "jaccard")
    w = Window.partitionBy("id")
    ranked = listed.select("id", "jaccard", F.row_number().over(w.orderBy("jaccard")).alias("r"), F.count("*").over(w).alias("listed"))
    # of n - 1 values, the middle one or the two middle ones, the zeros before the listed
    zeros = F.lit(n - 1) - F.col("listed")
    middle = ranked.filter((F.col("r") + zeros >= F.lit((n - 1) // 2 + (n - 1) % 2)) & (F.col("r") + zeros <= F.lit((n - 1) // 2 + 1)))
    med = middle.groupBy("id").agg((F.sum("jaccard") / (1 if (n - 1) % 2 else 2)).alias("m"))
    placed = items.select("id", "idx").join(med, "id", "left").select("id", "idx", F.coalesce("m", F.lit(0.0)).alias("median"))
    # an order of items, one small row each
    top = placed.orderBy("median", "idx").limit(n // 2 + 1)
    return top.orderBy(F.col("median").desc(), F.col("idx").desc()).limit(1)


def kmer_uniqueness(sketches: DataFrame) -> DataFrame:
    """(pos, uniqueness): the least 1/count of the hashes that stand at a position."""
    n = sketches.groupBy("hash", "pos").agg(F.count("*").alias("n"))
    return n.groupBy("pos").agg(F.min(F.lit(1.0) / F.col("n")).alias("uniqueness"))
