"""N-gram Jaccard join by vertical partitioning, down to connected components.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments:

* To find candidates, sets of like size are cut into one fragment more than two linked sets
  can differ in; by the pigeonhole principle they hold at least one equal fragment. A
  fragment's hash is a signature. Sets that share one, directly or through others, make a
  family; no link leaves a family, and unrelated texts share none.
* To verify, the order is cut into FRAGMENTS ranges, and each family into blocks of sets. A
  fragment of two blocks is one key of an exchange: its task counts the partial overlaps of
  the pairs. The partial counts of all fragments are then summed per pair; sums stay inside
  the task, which returns links that span what is linked, and each set's number of links.

Equal sets are one class from the start, so exact copies never pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_words, packed, release, shuffle_parts, small, spread_join, unpacked
from .components import connected

#: n-grams and sets of a block, at most about so many; ranges of the order that are counted apart.
BLOCK_GRAMS, BLOCK_SETS, FRAGMENTS = 400_000, 512, 4
#: n-grams of the sets that ask for frequencies together, at most about so many.
BATCH_GRAMS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """word -> 64-bit hash, kept for up to 400,000 words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h * _MIX


def gram_set(text: pa.Scalar, size: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of word n-grams; a shorter text is one n-gram, no word none."""
    words = lower_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + h[i : n - k + 1 + i] + np.uint64(i + 1))
    if k < size:
        out = mix(out ^ np.uint64(k))
    return np.unique(out)


def fingerprint(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 77))))


def _fragments(grams: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``parts`` equal ranges of the order, and which of them hold grams."""
    at = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
    body = total[edges[1:]] - total[edges[:-1]]
    return mix(body + mix(np.arange(parts, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(salt))), edges[1:] > edges[:-1]


def signatures(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the set's fragments, for its own size class and for the one below.

    Class c holds sizes from t^-c to t^-(c+1), at threshold t: linked sets lie in one class or
    in neighbours. Under class k, sets of classes k and k+1 are cut into 1 + d fragments,
    where d bounds how far a linked pair with its smaller set in class k can differ:
    |x ^ y| <= (|x|+|y|) (1-t)/(1+t). So one fragment at least is equal. Should the equal
    ones all be empty, both sets have an empty fragment; such sets add their half fragments,
    of which at least 2(1+d)-d are equal, more than are empty; else their empty ones as well.
    """
    n, t = len(grams), num / den
    own = int(log(n) / -log(t) + 1e-9)
    out = []
    for k in (own, own - 1):
        if k < 0:
            continue
        d = int((ceil(t ** -(k + 1)) + ceil(t ** -(k + 2))) * (den - num) / (den + num) + 1e-9)
        name, full = _fragments(grams, d + 1, 4 * k + 4)
        out.append(name[full])
        if not full.all():
            half, half_full = _fragments(grams, 2 * (d + 1), 4 * k + 5)
            out.append(half[half_full])
            if half_full.sum() <= d + 1:
                out.append(name[~full])
    return np.concatenate(out)


def _sets(df: DataFrame, size: int, emit, schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text): emit(batch's doc_ids, sets) yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            yield from emit(b.column(0), [gram_set(v, size, hashes) for v in b.column(1)])

    return df.select("doc_id", "text").mapInArrow(run, schema)


def named_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, fp) of every row; fp is null where there is no set."""
    return checkpointed(_sets(docs, size, lambda ids, sets: [_names(ids, sets)], "doc_id bigint, n_shingles bigint, fp bigint"))


def _names(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    fps = [fingerprint(g) if len(g) else None for g in sets]
    return pa.RecordBatch.from_arrays([ids, pa.array([len(g) for g in sets], pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "n_shingles", "fp"])


def families(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``named_sets`` and (node, comp): sets that share signatures, directly or through others.

    One pass over the texts makes both: rows of names have no part, rows of signatures one.
    """
    parts = 2 * shuffle_parts(docs.sparkSession)
    schema = pa.schema({"doc_id": pa.int64(), "n_shingles": pa.int64(), "fp": pa.int64(), "part": pa.int32(), "a": pa.binary(), "b": pa.binary()})

    def wide(batch: pa.RecordBatch) -> pa.RecordBatch:
        has = batch.schema.names
        return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in has else pa.nulls(len(batch), f.type) for f in schema], schema=schema)

    def emit(ids, sets):
        names = _names(ids, sets)
        yield wide(names)
        sigs, fps, done = [], [], set()
        for g, fp in zip(sets, names.column("fp").to_pylist(), strict=True):
            if fp is not None and fp not in done:
                done.add(fp)
                s = signatures(g, num, den)
                sigs.append(s)
                fps.append(np.full(len(s), fp, np.int64))
        if sigs:
            yield wide(_dealt(np.concatenate(sigs), np.concatenate(fps), parts))

    read = checkpointed(_sets(docs, size, emit, "doc_id bigint, n_shingles bigint, fp bigint, part int, a binary, b binary"))
    named = checkpointed(read.filter("part is null").select("doc_id", "n_shingles", "fp"))
    return named, connected(_met(read.filter("part is not null").select("part", "a", "b"), parts))


def _dealt(sig: np.ndarray, fp: np.ndarray, parts: int) -> pa.RecordBatch:
    """Signatures of a batch's sets, packed by the partition that gathers each signature."""
    # within the batch, a signature keeps its least set; the others link to that
    order = np.lexsort((fp, sig))
    sig, fp = sig[order], fp[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    head = fp[np.flatnonzero(first)[np.cumsum(first) - 1]]
    rows = [(-1, *_edges(fp, head))]
    sig, fp = sig[first], fp[first]
    part = (sig % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sig, fp, cut = sig[order], fp[order], np.searchsorted(part[order], np.arange(parts + 1))
    rows += [(p, sig[cut[p] : cut[p + 1]].tobytes(), fp[cut[p] : cut[p + 1]].tobytes()) for p in range(parts) if cut[p + 1] > cut[p]]
    rows[0] = (-1 - int(part[0]), *rows[0][1:])
    return _packed(rows)


def _met(dealt: DataFrame, parts: int) -> DataFrame:
    """Edges of the sets that share a signature, one partition of signatures a task."""
    dealt = dealt.withColumn("bin", F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")))
    return dealt.repartitionById(parts, "bin").groupBy("bin").applyInArrow(_stars, "a bigint, b bigint")


def _stars(t: pa.Table) -> pa.Table:
    """Within batches edges stand as they are; across them a signature's sets link to its least one."""
    known, met = [], []
    for part, a, b in zip(*(t.column(c).to_pylist() for c in ("part", "a", "b")), strict=True):
        (known if part < 0 else met).append((a, b))
    joined = lambda rows, at, kind: np.concatenate([np.frombuffer(r[at], kind) for r in rows] or [np.empty(0, kind)])
    x, y = joined(known, 0, np.int64), joined(known, 1, np.int64)
    if met:
        a, b = joined(met, 0, np.uint64), joined(met, 1, np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        x, y = np.concatenate([x, b]), np.concatenate([y, b[np.flatnonzero(first)[np.cumsum(first) - 1]]])
    x, y = (np.frombuffer(v, np.int64) for v in _edges(x, y))
    return pa.table({"a": x, "b": y})


def rare_families(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``named_sets`` and (node, comp) like ``families``, from prefixes of an order that has rare n-grams first.

    For thresholds where fragments hold so few n-grams that unrelated texts share one. Linked
    sets of n n-grams share one of their first n - ceil(t n) + 1 in any global order. This one
    is by the logarithm of an n-gram's frequency, then by 40 bits of its hash: passages that
    many texts share come last. N-grams that occur once signify nothing.

    A batch of sets sends its n-grams to the partitions of the order, which count them and send
    back those that occur elsewhere, with their class, and the number of the others. A batch is
    named by its sets in their order, so that batches of one name are equal; where copies of
    texts make several, they are answered as one. Sets are named and batches are filled in two
    passes, whose orders need not agree; a batch that comes back incomplete, as a part of it was
    made anew otherwise, fails the job.
    """
    parts = 2 * shuffle_parts(docs.sparkSession)
    schema = "batch bigint, part int, data binary"

    def rows_of(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["batch", "part", "data"])

    def batch(done: dict[int, np.ndarray]) -> pa.RecordBatch:
        fps, lens, grams = np.array(list(done), np.int64), np.array([len(g) for g in done.values()]), np.concatenate(list(done.values()))
        name = fingerprint(fps)
        owner = np.repeat(np.arange(len(fps)), lens)
        part = (grams % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((grams, part))
        grams, owner, cut = grams[order], owner[order], np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(name, p, packed(small(owner[cut[p] : cut[p + 1]]), grams[cut[p] : cut[p + 1]])) for p in range(parts) if cut[p + 1] > cut[p]]
        return rows_of([(name, -1 - name % parts, packed(fps, small(lens))), *rows])

    def ask(_, sets):
        done: dict[int, np.ndarray] = {}
        held = 0
        for g in sets:
            if len(g) and (fp := fingerprint(g)) not in done:
                done[fp] = g >> np.uint64(24)
                held += len(g)
                if held >= BATCH_GRAMS:
                    yield batch(done)
                    done, held = {}, 0
        if done:
            yield batch(done)

    def answer(t: pa.Table) -> pa.Table:
        rows, asked, known = [], [], set()
        for name, part, data in zip(*(t.column(c).to_pylist() for c in ("batch", "part", "data")), strict=True):
            if (name, part) in known:
                continue
            known.add((name, part))
            if part < 0:
                rows.append((name, part, data))
            else:
                asked.append((name, part, *unpacked(data)))
        if asked:
            _, at, count = np.unique(np.concatenate([x[3] for x in asked]), return_inverse=True, return_counts=True)
            kind = np.log2(count).astype(np.uint8)[at]
            ends = np.cumsum([len(x[3]) for x in asked])
            for (name, part, owner, grams), k in zip(asked, np.split(kind, ends[:-1]), strict=True):
                alone, times = np.unique(owner[k == 0], return_counts=True)
                rows.append((name, part, packed(alone, small(times), owner[k > 0], grams[k > 0], k[k > 0])))
        return pa.Table.from_batches([rows_of(rows)])

    def prefixes(t: pa.Table) -> pa.Table:
        names, owners, grams, kinds = None, [], [], []
        singles: list[tuple[np.ndarray, np.ndarray]] = []
        for part, data in zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True):
            if part < 0:
                names = unpacked(data)
            else:
                alone, times, o, g, k = unpacked(data)
                singles.append((alone, times))
                owners.append(o.astype(np.int64))
                grams.append(g)
                kinds.append(k)
        fps, lens = (names[0], names[1].astype(np.int64)) if names else (np.empty(0, np.int64), np.empty(0, np.int64))
        owner, grams, kinds = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, grams, kinds))
        alone = np.zeros(len(fps), np.int64)
        for o, n in singles:
            alone[o] += n
        seen = np.bincount(owner, minlength=len(fps)).astype(np.int64)
        if len(seen) != len(lens) or (seen + alone != lens).any():
            raise RuntimeError("a batch of sets came back incomplete; the documents must read alike each time")
        by_order = np.lexsort((grams, kinds, owner))
        rank = np.arange(len(grams)) - np.repeat(np.cumsum(seen) - seen, seen)
        first = by_order[rank < np.repeat(lens + (-num * lens) // den + 1 - alone, seen)]
        if not len(first):
            return pa.Table.from_batches([_packed([])])
        return pa.Table.from_batches([_dealt(grams[first], fps[owner[first]], parts)])

    asked = _sets(docs, size, ask, schema).withColumn("bin", F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")))
    answers = asked.repartitionById(parts, "bin").groupBy("bin").applyInArrow(answer, schema)
    met = answers.groupBy("batch").applyInArrow(prefixes, "part int, a binary, b binary")
    return named_sets(docs, size), connected(_met(met, parts))


def _edges(x: np.ndarray, y: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct pairs of different ends, packed."""
    keep = x != y
    if not keep.any():
        return b"", b""
    pairs = np.unique(np.stack([x[keep], y[keep]], axis=1), axis=0)
    return pairs[:, 0].tobytes(), pairs[:, 1].tobytes()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "a": pa.binary(), "b": pa.binary()}
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def overlap(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, counted fragment by fragment of the order and summed."""
    both = left if right is None else left + right
    grams, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    n = len(left)
    out = np.zeros((n, n if right is None else len(right)), np.float32)
    width = 8192
    # most n-grams stand in one set only and can't overlap
    if right is None:
        shared = np.bincount(column, minlength=len(grams)) > 1
    else:
        side = row >= n
        shared = (np.bincount(column[~side], minlength=len(grams)) > 0) & (np.bincount(column[side], minlength=len(grams)) > 0)
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    grams = grams[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(grams) + width, width))
    for f in range(len(cuts) - 1):
        at = slice(cuts[f], cuts[f + 1])
        m = np.zeros((len(both), width), np.float32)
        m[row[at], column[at] - f * width] = 1
        out += m[:n] @ (m if right is None else m[n:]).T
    return out


#: Rows of packed arrays under the key of their exchange.
_BLOCK = "g bigint, blk int, nb int, f int, data binary"
_PARTIAL = "g bigint, nb int, i int, j int, data binary"


def _one_row(schema: str, *values) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array([v], kinds[k]) for (n, k), v in zip((c.split() for c in schema.split(", ")), values, strict=True)})


def _fragmented(t: pa.Table) -> pa.Table:
    """A block's sets, cut at the same places of the order: one packed row a fragment."""
    sets = {}
    for comp, fp, raw in zip(*(t.column(c).to_pylist() for c in ("comp", "fp", "grams")), strict=True):
        sets[comp, fp] = np.frombuffer(raw, np.uint64)
    names = sorted(sets)
    comps, fps = (np.array(x, np.int64) for x in zip(*names, strict=True))
    edges = np.array([(f << 64) // FRAGMENTS for f in range(1, FRAGMENTS)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(sets[n], edges), [len(sets[n])]]) for n in names]
    g, blk, nb = (t.column(c)[0].as_py() for c in ("g", "blk", "nb"))
    out = []
    for f in range(FRAGMENTS):
        part = [sets[n][c[f] : c[f + 1]] for n, c in zip(names, cuts, strict=True)]
        # near copies hold the same n-grams: their places among the block's are small numbers
        grams, at = np.unique(np.concatenate(part), return_inverse=True)
        out.append(_one_row(_BLOCK, g, blk, nb, f, packed(comps, fps, small(np.array([len(x) for x in part])), grams, small(at))))
    return pa.concat_tables(out)


def _families_of(data: bytes):
    """(comp, fps, lengths, sets) of each family in a packed row."""
    comps, fps, lens, grams, at = unpacked(data)
    sets = np.split(grams[at.astype(np.int64)], np.cumsum(lens.astype(np.int64))[:-1])
    bounds = [0, *(np.flatnonzero(comps[1:] != comps[:-1]) + 1), len(comps)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(comps[a]), fps[a:b], lens[a:b].astype(np.int64), sets[a:b]


def _partial(t: pa.Table) -> pa.Table:
    """One fragment of two blocks, or of one with itself: how many n-grams each pair shares
    there, told as what is missing to the most it could, which is little for near copies."""
    g, nb, i, j = (t.column(c)[0].as_py() for c in ("g", "nb", "i", "j"))
    rows = dict(zip(t.column("blk").to_pylist(), t.column("data").to_pylist(), strict=True))
    out = [[], [], [], [], [], []]
    if i == j:
        for _, fps, lens, sets in _families_of(rows[i]):
            if len(fps) > 1:
                least = np.minimum(lens[:, None], lens[None, :])
                for to, x in zip(out, (np.array([len(fps)]), fps, lens, fps[:0], lens[:0], (least - overlap(sets)).astype(np.int64).ravel()), strict=True):
                    to.append(x)
    elif i in rows and j in rows:
        (_, fps, lens, sets), (_, fps2, lens2, sets2) = next(_families_of(rows[i])), next(_families_of(rows[j]))
        least = np.minimum(lens[:, None], lens2[None, :])
        out = [[np.array([len(fps)])], [fps], [lens], [fps2], [lens2], [(least - overlap(sets, sets2)).astype(np.int64).ravel()]]
    n, fps, lens, fps2, lens2, missing = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
    return _one_row(_PARTIAL, g, nb, i, j, packed(small(n), fps, small(lens), fps2, small(lens2), small(missing)))


def _total(num: int, den: int):
    """Sums the fragments' partial overlaps per pair; links that span what is linked."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in t.column("data").to_pylist()]
        if len(parts) != FRAGMENTS:
            raise RuntimeError("a fragment is missing")
        own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        sizes, fps, _, fps2 = parts[0][:4]
        out_a, out_b, out_n = [], [], []
        at = cell = 0
        for n in sizes.astype(np.int64):
            m = n if own else len(fps2)
            left, right = slice(at, at + n), slice(at, at + n) if own else slice(0, m)
            at += n
            inter, na, nb = np.zeros((n, m)), np.zeros(n), np.zeros(m)
            for x in parts:
                la = x[2][left].astype(np.int64)
                lb = (x[2] if own else x[4])[right].astype(np.int64)
                inter += np.minimum(la[:, None], lb[None, :]) - x[5][cell : cell + n * m].reshape(n, m).astype(np.int64)
                na += la
                nb += lb
            cell += n * m
            link = den * inter >= num * (na[:, None] + nb[None, :] - inter)
            names = fps[left]
            if own:
                np.fill_diagonal(link, False)
            else:
                whole = np.zeros((n + m, n + m), bool)
                whole[:n, n:], whole[n:, :n] = link, link.T
                link, names = whole, np.concatenate([fps, fps2])
            degree = link.sum(axis=1)
            label = np.arange(len(names))
            while True:
                least = np.minimum(label, np.where(link, label[None, :], len(names)).min(axis=1))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            hit = np.flatnonzero(degree)
            out_a.append(names[hit])
            out_b.append(names[label[hit]])
            out_n.append(degree[hit].astype(np.int64))
        a, b, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b, out_n))
        return pa.table({"a": a, "b": b, "n": n})

    return run


def components_of(docs: DataFrame, shingle: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of ``docs`` (doc_id, text).

    Texts are lower-cased in A-Z; a set holds the distinct n-grams of words, or the whole
    sequence where it is shorter. Two rows link when den * |x & y| >= num * |x | y|.
    component_id is the least doc_id that links reach; n_links counts the different sets that
    a row's set links with, its copies not among them. Null and wordless texts have no set
    and keep their own doc_id. Repeated ids are rows of their own. Every row is kept.
    """
    num, den = threshold
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    # below 0.85 a fragment holds under six n-grams
    candidates = families if 100 * num >= 85 * den else rare_families
    named, family = candidates(docs, shingle, num, den)
    family = checkpointed(family)
    release(docs.sparkSession)
    classes = named.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))

    sized = checkpointed(family.join(classes, family.node == classes.fp).groupBy("comp").agg(F.sum("n").alias("grams_n"), F.count("*").alias("sets_n")))
    blocks = F.greatest(F.ceil(F.col("grams_n") / BLOCK_GRAMS), F.ceil(F.col("sets_n") / BLOCK_SETS)).cast("int")
    plan = spread_join(family, sized.select("comp", "sets_n", blocks.alias("nb")), "comp", "sets_n", family.count()).select(F.col("node").alias("fp"), "comp", "nb")

    # one document of each class in a family makes the class's set anew
    heads = family.select(F.col("node").alias("fp")).join(classes, "fp").select(F.col("least").alias("head")).distinct()
    again = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")

    def members(_, sets):
        out = {fingerprint(g): g.tobytes() for g in sets if len(g)}
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["fp", "grams"])

    small_bins = 8 * shuffle_parts(docs.sparkSession)
    sets = _sets(again, shingle, members, "fp bigint, grams binary").join(plan, "fp").select(
        F.when(F.col("nb") == 1, F.pmod("comp", F.lit(small_bins))).otherwise(F.col("comp")).alias("g"),
        F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int").alias("blk"),
        "nb", "comp", "fp", "grams",
    )
    # families of one block share bins; those of more have keys of their own, told apart by nb
    cut = sets.groupBy("g", "blk", "nb").applyInArrow(_fragmented, _BLOCK)
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "nb", "f", "blk", "data"
    )
    partial = pairs.groupBy("g", "nb", "i", "j", "f").applyInArrow(_partial, _PARTIAL)
    links = checkpointed(partial.groupBy("g", "nb", "i", "j").applyInArrow(_total(num, den), "a bigint, b bigint, n bigint"))

    release(docs.sparkSession)
    comps = connected(links.filter("a <> b").select("a", "b"))
    counted = links.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_links"))
    by_class = checkpointed(classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").join(counted, "fp", "left"))
    least = by_class.filter("comp is not null").groupBy("comp").agg(F.min("least").alias("component"), F.count("*").alias("classes"))
    by_class = spread_join(by_class, least, "comp", "classes", family.count())
    by_class = checkpointed(by_class.select("fp", "copies", F.coalesce("component", "least").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return spread_join(named, by_class, "fp", "copies", named.count()).select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
c AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY 2, 3),
g AS (SELECT id, n, unnest(s) AS gram FROM c),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT g.id, g.n, g.gram, row_number() OVER (PARTITION BY g.id ORDER BY coalesce(f.df, 1), g.gram) AS r FROM g LEFT JOIN f USING (gram)),
p AS (SELECT * FROM o WHERE r <= n - ceil(0.9 * n - 1e-9) + 1),
k AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.gram = b.gram AND a.id < b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
l AS (
  SELECT x, y FROM (SELECT k.x, k.y, len(list_intersect(a.s, b.s)) AS i, a.n AS an, b.n AS bn FROM k JOIN c a ON a.id = k.x JOIN c b ON b.id = k.y)
  WHERE 100 * i >= 90 * (an + bn - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT id AS x, id AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS id, min(y) AS component FROM r GROUP BY 1),
d AS (SELECT x AS id, count(*) AS n_links FROM e GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(d.n_links, 0)::BIGINT AS n_links
FROM s LEFT JOIN c ON c.s = list_sort(s.s) LEFT JOIN m ON m.id = c.id LEFT JOIN d ON d.id = c.id
"""
