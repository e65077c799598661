"""Katz backoff bigram model: Good-Turing discounts and exactly normalised backoff weights.

    P(w | v) = r* / c(v)                     r = c(v w) > 0
             = alpha(v) P1(w)                r = 0, c(v) > 0
             = P1(w)                         c(v) = 0
    P1(w)    = c(w)* / N, and what discounts free goes to one unknown word
    alpha(v) = (1 - sum of P(w|v) over w seen after v) / (1 - sum of P1(w) over these w)

Counts up to K keep the Good-Turing share, r* = d(r) r, larger ones are taken as they are;
but every count gives up LEAST of one, so that each context frees something and its
probabilities sum to 1 with what it backs off to.

The start of a text is the context that the end of one leaves. All of this is a sum over a
text's tokens, and the sum is dealt by words: blocks of texts send, to the partition of a
word, the places where the word stands and its neighbours there. A partition so holds all
counts of its words and of the pairs filed under them, writes down what they add to each
text, and passes on, per context, what alpha needs and where backoff happens. Neither texts
nor the model are gathered anywhere.

Frequent words would make hot partitions. A fixed number of them (HOT), picked from a hashed
share of all texts, is counted first, with all pairs among them; these counts have a fixed size and go to all
tasks. Which words are picked changes where work happens, never a result. Pairs of a frequent
and another word are filed under the other one.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, ascii_lower, checkpointed, lower_words, packed, release, shuffle_parts, small, unpacked

#: Frequent words; discounts apply to counts up to K; tokens of a block of texts, at least.
HOT, K, BLOCK_TOKENS = 1023, 5, 800_000
#: Every count is discounted by so much at least.
LEAST = 0.1
#: One text in so many, by a hash, tells which words are frequent.
PICKED = 16
EDGE = 0  # the code of a text's start and end; frequent words are 1..HOT


class _Codes(dict):
    """word -> its code: 1..HOT for frequent words, else a hash with the top bit set."""

    def __init__(self, hot: list[str]):
        super().__init__()
        self.hot = {w.encode(): i + 1 for i, w in enumerate(hot)}

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        got = self[word] = self.hot.get(word) or xxhash.xxh64_intdigest(word) | (1 << 63)
        return got


def _codes(text: pa.Scalar, codes: _Codes) -> np.ndarray:
    """A text's words between two edges."""
    words = lower_words(text)
    out = np.zeros(len(words) + 2, np.uint64)
    out[1:-1] = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    return out


def frequent_words(docs: DataFrame) -> list[str]:
    """Up to HOT words, the most frequent of one text in PICKED; they only steer how work is dealt."""
    rows = docs.filter("text is not null").filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(PICKED)) == 0).select("text")
    words = F.explode(F.filter(F.split("text", WORD_SPLIT), lambda w: w != ""))
    top = rows.select(words.alias("w")).groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(2 * HOT)
    seen = Counter()
    for w, n in top.collect():
        seen[ascii_lower(w)] += n
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:HOT]]


def hot_pairs(docs: DataFrame, hot: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Exact training counts: of pairs of frequent words, of each of them, of all tokens.

    The last row and column of the pairs hold what lies outside; (HOT+2)^2 numbers at most.
    """
    size = HOT + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(hot)
        total = np.zeros(size * size, np.int64)
        held, tokens = [], 0
        for b in batches:
            for v, train in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if train:
                    c = np.minimum(_codes(v, codes), np.uint64(HOT + 1)).astype(np.int64)
                    held.append(c[:-1] * size + c[1:])
                    tokens += len(c)
                    if tokens >= BLOCK_TOKENS:
                        total += np.bincount(np.concatenate(held), minlength=size * size)
                        held, tokens = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size * size)
        at = np.flatnonzero(total)
        # packed by ranges of rows, so that partial sums of a range meet in one task each
        for part in range(16):
            mine = at[(at // size) % 16 == part]
            if len(mine):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(small(mine), small(total[mine]))], pa.binary())], names=["part", "data"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size * size, np.int64)
        for data in t.column("data").to_pylist():
            at, n = unpacked(data)
            total[at.astype(np.int64)] += n.astype(np.int64)
        at = np.flatnonzero(total)
        return pa.table({"data": pa.array([packed(small(at), small(total[at]))], pa.binary())})

    counted = docs.select("text", "train").mapInArrow(run, "part int, data binary")
    pairs = np.zeros(size * size, np.int64)
    for (data,) in counted.groupBy("part").applyInArrow(add, "data binary").collect():
        at, n = unpacked(data)
        pairs[at.astype(np.int64)] += n.astype(np.int64)
    pairs = pairs.reshape(size, size)
    return pairs, pairs.sum(axis=0), int(pairs.sum())


# ---------------------------------------------------------------- packed tables
# Rows (part, kind, block, data): arrays of one block of texts for one partition.
_PACKED = "part int, kind int, block binary, data binary"


#: Sums of logarithms travel as whole multiples of 1 / POINT, which shortens them by a third.
POINT = float(1 << 32)


def _fixed(a: np.ndarray) -> np.ndarray:
    return np.rint(a * POINT).astype(np.int64)


def _row(part: int, kind: int, block: bytes, *arrays: np.ndarray) -> tuple:
    return part, kind, block, packed(*arrays)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "kind", "block", "data"])


def _slices(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p + 1] > cut[p]:
            yield p, order[cut[p] : cut[p + 1]]


#: Kinds of rows that blocks of texts send out, and that words' partitions pass on.
POSTINGS, LOCAL, SUMS, CONTEXT, BACKOFF = 0, 1, 2, 3, 4

#: What a text's sums hold. base: sum of log10(c+1); known: tokens with c > 0; fixed: the sum
#: of all logarithms that need no discount; seen: pairs of count r = 1..K; uni: backed-off
#: words by count: unknown, 1..K, more.
_FIELDS = 3 + K + (K + 2)
BASE, KNOWN, FIXED, SEEN, UNI = 0, 1, 2, 3, 3 + K


def _spread(docs: DataFrame, hot: list[str], pairs: np.ndarray, uni: np.ndarray, parts: int) -> DataFrame:
    """Per block of texts: rows LOCAL (ids and sums over frequent words) and POSTINGS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(hot)
        hot_uni = uni[: HOT + 1]
        seen = pairs[: HOT + 1, : HOT + 1].ravel()
        ids, train, texts, tokens, serial = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, train, texts, tokens, serial
            n = len(ids)
            block = struct.pack("<qq", TaskContext.get().partitionId(), serial)
            serial += 1
            spread_to = (TaskContext.get().partitionId() * 7919 + serial) % parts
            size = np.array([len(x) for x in texts])
            trained = np.array(train, bool)
            doc = np.repeat(np.arange(n), size - 1)
            left = np.concatenate([x[:-1] for x in texts])
            right = np.concatenate([x[1:] for x in texts])
            texts = []
            top = np.uint64(HOT)
            lh, rh = left <= top, right <= top
            sums = np.zeros((n, _FIELDS))
            # frequent words by themselves: as predicted tokens and as contexts
            c = hot_uni[right[rh].astype(np.int64)]
            sums[:, BASE] += np.bincount(doc[rh], np.log10(c + 1.0), n)
            sums[:, KNOWN] += np.bincount(doc[rh], c > 0, n)
            c = hot_uni[left[lh].astype(np.int64)]
            sums[:, FIXED] -= np.bincount(doc[lh], np.log10(np.maximum(c, 1)), n)
            # pairs of two frequent words
            both = lh & rh
            d, a, b = doc[both], left[both].astype(np.int64), right[both].astype(np.int64)
            backoff = _pair_sums(sums, d, np.ones(len(d)), seen[a * (HOT + 1) + b], hot_uni[b], a.astype(np.uint64), n)
            rows = [_row(spread_to, LOCAL, block, np.array([x if x is not None else 0 for x in ids], np.int64), np.array([x is not None for x in ids], np.uint8), small(size - 1), trained.astype(np.uint8), *[sums[:, f] for f in range(3)], *[small(sums[:, f].astype(np.int64)) for f in range(3, _FIELDS)])]
            if len(backoff[0]):
                for p, at in _slices((backoff[1] % np.uint64(parts)).astype(np.int64), parts):
                    rows.append(_row(p, BACKOFF, b"", np.frombuffer(block, np.uint64), small(np.zeros(len(at), np.int64)), small(backoff[0][at]), backoff[1][at], small(backoff[2][at])))
            # each rare word with its places: as predicted token, as context, and in pairs
            rest = ~both
            d, a, b = doc[rest], left[rest], right[rest]
            under_right = b > top
            key = np.where(under_right, b, a)
            other = np.where(under_right, a, b)
            # a word that is not filed under as predicted or context still counts there
            both_rare = (a > top) & (b > top)
            words, place = np.unique(np.concatenate([key, a[both_rare]]), return_inverse=True)
            k = place[: len(key)]
            ctx = np.concatenate([np.stack([k[~under_right], d[~under_right]]), np.stack([place[len(key) :], d[both_rare]])], axis=1)
            others, o = np.unique(other, return_inverse=True)
            # equal places of a text go together
            code = ((k.astype(np.int64) * 2 + under_right) * len(others) + o) * n + d
            code, times = np.unique(code, return_counts=True)
            pd = code % n
            po = (code // n) % len(others) if len(others) else code
            pk = code // (n * max(1, len(others)))
            pr, pk = pk % 2, pk // 2
            del key, other, left, right, doc, lh, rh, both, rest, both_rare, a, b, d, k, o, place, code
            ctx_code, ctx_n = np.unique(ctx[0].astype(np.int64) * n + ctx[1], return_counts=True)
            ck, cd = ctx_code // n, ctx_code % n
            owner = (words % np.uint64(parts)).astype(np.int64)
            by_pair = dict(_slices(owner[pk], parts))
            by_ctx = dict(_slices(owner[ck], parts))
            none = np.empty(0, np.int64)
            for p, w in _slices(owner, parts):
                at, cat = by_pair.get(p, none), by_ctx.get(p, none)
                local, mine = np.unique(others[po[at]], return_inverse=True)
                is_hot = local <= top
                # words are sorted, so that places rise; differences are small
                wk = np.searchsorted(w, pk[at]) if len(at) else none
                rows.append(_row(
                    p, POSTINGS, block, words[w], small(local[is_hot]), local[~is_hot], small(np.diff(wk, prepend=0)), pr[at].astype(np.uint8),
                    small(mine), small(pd[at]), small(times[at]), small(np.searchsorted(w, ck[cat])), small(cd[cat]), small(ctx_n[cat]), trained.astype(np.uint8),
                ))
            ids, train, texts, tokens = [], [], [], 0
            return _batch(rows)

        for b in batches:
            for i, v, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                c = _codes(v, codes)
                ids.append(i)
                train.append(t)
                texts.append(c)
                tokens += len(c)
                if tokens >= BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(run, _PACKED)


def _kept(r: np.ndarray) -> np.ndarray:
    """Counts up to K as they are, whose discounts come later; larger ones less LEAST."""
    return np.where(r > K, r - LEAST, r)


def _pair_sums(sums: np.ndarray, doc, times, r, c_right, left, n: int):
    """Adds pairs to their texts' sums; returns (doc, context, times) of those that back off."""
    hit = r > 0
    sums[:, FIXED] += np.bincount(doc[hit], times[hit] * np.log10(_kept(r[hit])), n)
    for i in range(1, K + 1):
        at = r == i
        if at.any():
            sums[:, SEEN + i - 1] += np.bincount(doc[at], times[at], n)
    miss = ~hit
    d, t, c = doc[miss], times[miss], c_right[miss]
    sums[:, FIXED] += np.bincount(d, t * np.log10(_kept(np.maximum(c, 1))), n)
    for i in range(K + 2):
        at = c == i if i <= K else c > K
        if at.any():
            sums[:, UNI + i] += np.bincount(d[at], t[at], n)
    return d, left[miss], t.astype(np.int64)


def _owned(uni: np.ndarray, parts: int):
    """A word partition: counts its words and pairs, and says what they add to texts."""
    hot_uni = uni[: HOT + 1]

    def run(t: pa.Table) -> pa.Table:
        kind = np.array(t.column("kind").to_pylist())
        block, data = t.column("block").to_pylist(), t.column("data").to_pylist()
        rows = [(t.column("part")[0].as_py(), int(kind[i]), block[i], data[i]) for i in np.flatnonzero(kind != POSTINGS)]
        mine = np.flatnonzero(kind == POSTINGS)
        if not len(mine):
            return pa.Table.from_batches([_batch(rows)])
        parsed = []
        for i in mine:
            words, hot, rare, wk, pr, o, pd, times, ck, cd, cn, trained = unpacked(data[i])
            others = np.concatenate([hot.astype(np.uint64), rare])
            narrow = [a.astype(np.int32) for a in (o, pd, times, ck, cd, cn)]
            parsed.append([words, others, np.cumsum(wk, dtype=np.int32), pr.astype(bool), *narrow, trained.astype(bool)])
        words = np.unique(np.concatenate([x[0] for x in parsed]))
        others = np.unique(np.concatenate([x[1] for x in parsed]))
        count = np.zeros(len(words), np.int64)
        keys, weights = [], []
        for x in parsed:
            x[2] = np.searchsorted(words, x[0]).astype(np.int32)[x[2]] if len(x[2]) else x[2]
            x[7] = np.searchsorted(words, x[0]).astype(np.int32)[x[7]] if len(x[7]) else x[7]
            x[4] = np.searchsorted(others, x[1]).astype(np.int32)[x[4]] if len(x[4]) else x[4]
            train = x[10][x[5]]
            # a word's count: where it is predicted; all these pairs are filed under it
            predicted = x[3] & train
            count += np.bincount(x[2][predicted], x[6][predicted], len(words)).astype(np.int64)
            keys.append((x[2].astype(np.int64) * 2 + x[3]) * max(1, len(others)) + x[4])
            weights.append(np.where(train, x[6], 0))
        code, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        r = np.bincount(inverse, np.concatenate(weights), len(code)).astype(np.int64)
        at = 0
        backoff = []
        del keys, weights
        for i, x in zip(mine, parsed, strict=True):
            n = len(x[10])
            m = len(x[2])
            pr_r = r[inverse[at : at + m]]
            at += m
            sums = np.zeros((n, _FIELDS))
            c = count[x[2]]
            right = x[3]
            sums[:, BASE] += np.bincount(x[5][right], x[6][right] * np.log10(c[right] + 1.0), n)
            sums[:, KNOWN] += np.bincount(x[5][right], x[6][right] * (c[right] > 0), n)
            cc = count[x[7]]
            sums[:, FIXED] -= np.bincount(x[8], x[9] * np.log10(np.maximum(cc, 1)), n)
            other = others[x[4]]
            c_right = np.where(right, c, hot_uni[np.where(right, 0, other).astype(np.int64)]) if m else c
            left = np.where(right, other, words[x[2]])
            d, ctx, times = _pair_sums(sums, x[5], x[6], pr_r, c_right, left, n)
            some = np.flatnonzero(np.abs(sums).sum(axis=1) > 0)
            part = sums[some]
            rows.append(_row(-1, SUMS, block[i], small(some), _fixed(part[:, BASE]), small(part[:, KNOWN].astype(np.int64)), _fixed(part[:, FIXED]), *[small(part[:, f].astype(np.int64)) for f in range(3, _FIELDS)]))
            if len(d):
                backoff.append((np.frombuffer(block[i], np.uint64), d, ctx, times))
        # backoff of all blocks goes to its contexts' partitions together
        if backoff:
            names = np.concatenate([x[0] for x in backoff])
            of = np.repeat(np.arange(len(backoff)), [len(x[1]) for x in backoff])
            d, ctx, times = (np.concatenate([x[f] for x in backoff]) for f in (1, 2, 3))
            for p, s in _slices((ctx % np.uint64(parts)).astype(np.int64), parts):
                some, local = np.unique(of[s], return_inverse=True)
                rows.append(_row(p, BACKOFF, b"", names.reshape(-1, 2)[some].ravel(), small(local), small(d[s]), ctx[s], small(times[s])))
        # per context: its count, its discounted pairs, and the unigram mass of what follows
        seen = r > 0
        code, r = code[seen], r[seen]
        o = code % max(1, len(others))
        w, right = code // max(1, len(others)) // 2, (code // max(1, len(others))) % 2 == 1
        left = np.where(right, others[o], words[w])
        c_right = np.where(right, count[w], hot_uni[np.where(right, 0, others[o]).astype(np.int64)]) if len(o) else r
        rows += _context_rows(left, r, c_right, parts)
        rows.append((-3, CONTEXT, b"", packed(np.bincount(np.minimum(r, K + 2), minlength=K + 3), np.bincount(np.minimum(count, K + 2), minlength=K + 3))))
        return pa.Table.from_batches([_batch(rows)])

    return run


#: Columns of a context, over the words seen after it: its count, how many stand there r = 1..K
#: times and more often; the count of the words of more than K, how many count 1..K and more.
PAIR_TYPES, WORD_MASS, WORD_TYPES = 2, 2 + K + 1, 2 + K + 2


def _context_rows(left: np.ndarray, r: np.ndarray, c_right: np.ndarray, parts: int) -> list[tuple]:
    ctx, inverse = np.unique(left, return_inverse=True)
    kinds = lambda x: [np.bincount(inverse[np.minimum(x, K + 1) == i], minlength=len(ctx)) for i in range(1, K + 2)]
    big = c_right > K
    cols = [np.bincount(inverse, r, len(ctx)).astype(np.int64), *kinds(r)]
    cols += [np.bincount(inverse[big], c_right[big], len(ctx)).astype(np.int64), *kinds(c_right)]
    return [_row(p, CONTEXT, b"", ctx[s], *[small(c[s]) for c in cols]) for p, s in _slices((ctx % np.uint64(parts)).astype(np.int64), parts)]


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d(r) for r = 0..K from counts of counts n[1..K+1], 1 - LEAST / r at most; that
    also where the counts of counts allow none."""
    d = np.ones(K + 1)
    d[1:] -= LEAST / np.arange(1, K + 1)
    if n[1] > 0:
        tail = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and tail < 1:
                turing = (r + 1) * n[r + 1] / (r * n[r])
                v = (turing - tail) / (1 - tail)
                if v > 0:
                    d[r] = min(d[r], v)
    return d


def freed(d: np.ndarray, types: list) -> np.ndarray:
    """What discounts take from counts, of which types[i] are i + 1, the last more than K."""
    return sum((1 - d[i]) * i * types[i - 1] for i in range(1, K + 1)) + LEAST * types[K]


def train_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Learns from rows where ``held_out`` is not true and scores all. Null texts are empty: one
    token, the end. Repeated ids are rows of their own; an empty table gives an empty one. No
    other column of ``docs`` is read but those of ``held_out``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (~F.coalesce(held_out, F.lit(False))).alias("train"))
    parts = shuffle_parts(spark)
    hot = frequent_words(docs)
    pairs, uni, total = hot_pairs(docs, hot)
    spread = _spread(docs, hot, pairs, uni, parts)
    # one part a partition: hashed together, several might meet in one task
    filed = checkpointed(spread.repartitionById(parts, "part").groupBy("part").applyInArrow(_owned(uni, parts), _PACKED))
    del spread
    release(spark)

    # counts of counts: one small row per partition, and the frequent words' own
    inside = pairs[: HOT + 1, : HOT + 1]
    pair_n = np.bincount(np.minimum(inside.ravel(), K + 2), minlength=K + 3)
    uni_n = np.bincount(np.minimum(uni[: HOT + 1], K + 2), minlength=K + 3)
    vocabulary = int((uni[: HOT + 1] > 0).sum())
    for (data,) in filed.filter("part = -3").select("data").toLocalIterator():
        a, b = unpacked(data)
        pair_n, uni_n = pair_n + a, uni_n + b
        vocabulary += int(b[1:].sum())
    d2, d1 = discounts(pair_n), discounts(uni_n)
    # what the unigrams' discounts free is the unknown word's, and all where nothing was seen
    mass = max(1, total)
    unknown = freed(d1, [*uni_n[1 : K + 1], uni_n[K + 1] + uni_n[K + 2]]) / mass if total else 1.0
    model = (d1, d2, unknown, mass, total, vocabulary)

    own = [r for r in _context_rows(*_hot_contexts(inside, uni), parts)]
    hot_rows = spark.createDataFrame([(int(p), int(k), bytearray(b), bytearray(x)) for p, k, b, x in own] or [], _PACKED)
    contexts = filed.filter(F.col("kind").isin(CONTEXT, BACKOFF) & (F.col("part") >= 0)).union(hot_rows)
    backed = contexts.repartitionById(parts, "part").groupBy("part").applyInArrow(_back_off(model), _PACKED)
    final = filed.filter(F.col("kind").isin(LOCAL, SUMS)).union(backed)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return final.groupBy("block").applyInArrow(_totals(model), schema)


def _hot_contexts(inside: np.ndarray, uni: np.ndarray):
    a, b = np.nonzero(inside)
    return a.astype(np.uint64), inside[a, b], uni[b]


def _back_off(model):
    d1, d2, _, mass, _, _ = model

    def run(t: pa.Table) -> pa.Table:
        kind, block, data = (t.column(c).to_pylist() for c in ("kind", "block", "data"))
        ctx = [unpacked(x) for k, x in zip(kind, data, strict=True) if k == CONTEXT]
        words, value = np.empty(0, np.uint64), np.empty(0)
        if ctx:
            every = np.concatenate([x[0] for x in ctx])
            words, inverse = np.unique(every, return_inverse=True)
            add = lambda f: np.bincount(inverse, np.concatenate([x[f].astype(np.float64) for x in ctx]), len(words))
            count = add(1)
            left = freed(d2, [add(PAIR_TYPES + i) for i in range(K + 1)]) / count
            words_ = [add(WORD_TYPES + i) for i in range(K + 1)]
            after = (add(WORD_MASS) + sum(i * words_[i - 1] for i in range(1, K + 1)) - freed(d1, words_)) / mass
            value = np.log10(left / (1 - after)) + np.log10(count)
        names, of, doc, worth, base = [], [], [], [], 0
        for k, x in zip(kind, data, strict=True):
            if k == BACKOFF:
                name, local, d, c, n = unpacked(x)
                if len(words):
                    at = np.minimum(np.searchsorted(words, c), len(words) - 1)
                    v = np.where(words[at] == c, value[at], 0.0)
                else:
                    v = np.zeros(len(c))
                names.append(name.reshape(-1, 2))
                of.append(local.astype(np.int64) + base)
                base += len(name) // 2
                doc.append(d.astype(np.int64))
                worth.append(v * n)
        rows = []
        if names:
            blocks, which = np.unique(np.concatenate(names), axis=0, return_inverse=True)
            d = np.concatenate(doc)
            span = int(d.max()) + 1
            key, inverse = np.unique(which.ravel()[np.concatenate(of)] * span + d, return_inverse=True)
            total_ = np.bincount(inverse, np.concatenate(worth), len(key))
            cut = np.searchsorted(key, np.arange(len(blocks) + 1) * span)
            for i, b in enumerate(blocks):
                s = slice(cut[i], cut[i + 1])
                rows.append(_row(-1, BACKOFF, b.tobytes(), small(key[s] - i * span), total_[s]))
        return pa.Table.from_batches([_batch(rows)] if rows else [], pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.binary()), ("data", pa.binary())]))

    return run


def _totals(model):
    d1, d2, unknown, mass, total, vocabulary = model
    log_d2 = np.log10(d2[1:])
    log_uni = np.concatenate([[log10(unknown)], np.log10(d1[1:]) - log10(mass), [-log10(mass)]])

    def run(t: pa.Table) -> pa.Table:
        kind, data = t.column("kind").to_pylist(), t.column("data").to_pylist()
        local = next(unpacked(x) for k, x in zip(kind, data, strict=True) if k == LOCAL)
        ids, known_id, tokens, train = local[:4]
        n = len(ids)
        sums = np.stack([c.astype(np.float64) for c in local[4:]], axis=1)
        extra = np.zeros(n)
        for k, x in zip(kind, data, strict=True):
            if k == SUMS:
                some, *cols = unpacked(x)
                cols = [c.astype(np.float64) for c in cols]
                cols[BASE] /= POINT
                cols[FIXED] /= POINT
                sums[some.astype(np.int64)] += np.stack(cols, axis=1)
            elif k == BACKOFF:
                d, v = unpacked(x)
                extra[d.astype(np.int64)] += v
        tokens = tokens.astype(np.int64)
        score = sums[:, FIXED] + sums[:, SEEN : SEEN + K] @ log_d2 + sums[:, UNI : UNI + K + 2] @ log_uni + extra
        base = sums[:, BASE] - tokens * log10(total + vocabulary + 1)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=known_id == 0), "held_out": pa.array(train == 0), "n_tokens": tokens,
            "n_known": np.rint(sums[:, KNOWN]).astype(np.int64), "train_tokens": np.full(n, total, np.int64), "base_score": base, "score": score,
        })

    return run
