"""The sequential kernels, in Python and numpy, usable without Spark.

CIGAR letters: M match, X mismatch, I target-only base, D query-only base.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from math import floor, log2

import numpy as np


@dataclass(frozen=True)
class ChainParams:
    seed_len: int = 21
    max_band: int = 100
    max_dist: int = 100
    max_iter: int = 5000
    max_skip: int = 25
    gap_penalty: float = 0.21
    min_score: int = 25


def chain_seeds(seeds: list[tuple[int, int]], p: ChainParams = ChainParams()) -> list[tuple[int, list[tuple[int, int]]]]:
    """Collinear chains of (query_pos, target_pos), best first: [(score, seeds)].

    A chain gains, per step, the new bases a seed covers less a concave cost of the change of
    diagonal; steps reach max_dist + seed_len in the target. Looking back for a seed's best
    predecessor ends after max_skip candidates that had themselves lost that often before.
    Seeds belong to one chain; a chain's score is that of its end, also where a better chain
    has its first seeds.
    """
    s = sorted(set(seeds), key=lambda x: (x[1], x[0]))
    reach = p.max_dist + p.seed_len
    best, back, lost = [p.seed_len] * len(s), [-1] * len(s), [0] * len(s)
    for i, (qi, ti) in enumerate(s):
        idle = 0
        for j in range(i - 1, max(-1, i - 1 - p.max_iter), -1):
            qj, tj = s[j]
            dq, dt = qi - qj, ti - tj
            if dt >= reach:
                break
            drift = abs(dt - dq)
            if dq <= 0 or dt <= 0 or drift > p.max_band:
                continue
            cost = floor(p.gap_penalty * drift + 0.5 * log2(drift + 1) + 0.5) if drift else 0
            v = best[j] + min(p.seed_len, dq, dt) - cost
            if v > best[i]:
                best[i], back[i] = v, j
                idle -= idle > 0
                continue
            lost[j] += 1
            idle += lost[j] > p.max_skip
            if idle > p.max_skip:
                break
    used = [False] * len(s)
    out = []
    for i in sorted(range(len(s)), key=lambda i: -best[i]):
        if best[i] < p.min_score:
            break
        path, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(s[at])
            at = back[at]
        if path:
            out.append((best[i], sorted(path)))
    return out


def target_start(chain: list[tuple[int, int]]) -> int:
    return max(chain[0][1] - chain[0][0], 0)


def compact(ops: str) -> str:
    return "".join(f"{len(list(g))}{op}" for op, g in groupby(ops))


def expand(cigar: str) -> str:
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            out.append(c * int(n or 1))
            n = ""
    return "".join(out)


def matching_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


@dataclass(frozen=True)
class Alignment:
    cigar: str
    edit_distance: int
    target_end: int


def align_wavefront(query: bytes, target: bytes, fitting: bool = True, max_edits: int | None = None) -> Alignment | None:
    """Edit-distance alignment by wavefronts; None past max_edits.

    Per number of edits, the furthest target position on each diagonal (target - query). On
    ties a target-only step goes before a query-only one, and that before a mismatch. fitting:
    the query is consumed, the target's end is free, of equal distances the one that consumes
    most; otherwise both ends are fixed. The start is fixed in either case.
    """
    n, m = len(query), len(target)
    q, t = np.frombuffer(query, np.uint8), np.frombuffer(target, np.uint8)
    bound = n + m if max_edits is None else max_edits
    low = -(bound + 1)
    history = []
    front: dict[int, int] = {}

    def slide(d: int, at: int) -> int:
        """Along the diagonal while bases match."""
        while at < m and at - d < n:
            size = min(64, m - at, n - at + d)
            same = q[at - d : at - d + size] == t[at : at + size]
            k = size if same.all() else int(np.argmin(same))
            at += k
            if k < size:
                break
        return at

    for s in range(bound + 1):
        new: dict[int, int] = {}
        if s == 0:
            new[0] = slide(0, 0)
        else:
            for d in range(min(front) - 1, max(front) + 2):
                steps = [front[d] + 1 if d in front else low, front.get(d + 1, low), front[d - 1] + 1 if d - 1 in front else low]
                at = max(x if 0 <= x <= m and 0 <= x - d <= n else low for x in steps)
                if at > low:
                    new[d] = slide(d, at)
        history.append(new)
        ends = [at for d, at in new.items() if at - d == n and (fitting or at == m)]
        if ends:
            end = max(ends)
            return Alignment(compact(_walk_back(history, q, t, s, end, n)), s, end)
        if not new:
            return None
        front = new
    return None


def _walk_back(history: list[dict[int, int]], q, t, s: int, at: int, n: int) -> str:
    ops: list[str] = []
    d = at - n
    while s > 0:
        prev = history[s - 1]
        # where this wavefront stood before it slid
        options = []
        if d - 1 in prev:
            options.append((prev[d - 1] + 1, 2, "I", d - 1))
        if d + 1 in prev:
            options.append((prev[d + 1], 1, "D", d + 1))
        if d in prev:
            options.append((prev[d] + 1, 0, "X", d))
        options = [o for o in options if o[0] <= at and o[0] - d <= n and o[0] >= 0 and o[0] - d >= 0]
        begin, _, op, other = max(options)
        ops.append("M" * (at - begin))
        ops.append(op)
        at = begin - (op != "D")
        d = other
        s -= 1
    ops.append("M" * at)
    return "".join(x[::-1] for x in reversed(ops))


def align_rows(query: bytes, target: bytes, fitting: bool = True) -> Alignment:
    """The same distance by dynamic programming, one vectorised row per query base; of equal
    distances the end that consumes least. Meant for short queries.

    Tracing back, query-only goes before target-only, and these before the diagonal.
    """
    n, m = len(query), len(target)
    q, t = np.frombuffer(query, np.uint8), np.frombuffer(target, np.uint8)
    steps = np.arange(m + 1, dtype=np.int32)
    rows = np.empty((n + 1, m + 1), np.int32)
    rows[0] = steps
    for i in range(1, n + 1):
        up = rows[i - 1]
        new = up + 1
        new[1:] = np.minimum(new[1:], up[:-1] + (t != q[i - 1]))
        # target-only steps: a running minimum along the row, less the distance walked
        rows[i] = np.minimum.accumulate(new - steps) + steps
    j = int(np.argmin(rows[n])) if fitting else m
    end, i, ops = j, n, []
    while i > 0 or j > 0:
        v = rows[i, j]
        if i > 0 and v == rows[i - 1, j] + 1:
            ops.append("D")
            i -= 1
        elif j > 0 and v == rows[i, j - 1] + 1:
            ops.append("I")
            j -= 1
        else:
            i, j = i - 1, j - 1
            ops.append("M" if q[i] == t[j] else "X")
    return Alignment(compact("".join(reversed(ops))), int(rows[n, end]), end)


def align_bits(query: bytes, target: bytes, fitting: bool = True, max_edits: int | None = None) -> Alignment | None:
    """`align_rows` with a whole column of the table in two bit vectors (Myers 1999, Hyyro 2003);
    the same path on ties. None past max_edits, which also ends the columns early.

    A column keeps where its values rise downwards, and where they rise from the column before.
    """
    n, m = len(query), len(target)
    ones, top = (1 << n) - 1, 1 << n >> 1
    hits: dict[int, int] = {}
    for i, c in enumerate(query):
        hits[c] = hits.get(c, 0) | 1 << i
    rise, fall, score = ones, 0, n
    rises, grows = [ones], [0]
    best, end = (n, 0) if fitting else (n + m, m)
    limit = n + m if max_edits is None else max_edits
    for j, c in enumerate(target, 1):
        eq = hits.get(c, 0)
        x = ((eq & rise) + rise ^ rise | eq) & ones
        up = fall | ones & ~(x | rise)
        down = rise & x
        if n:
            score += (up & top > 0) - (down & top > 0)
        else:
            score = j
        grows.append(up)
        up, down, keep = up << 1 & ones | 1, down << 1 & ones, eq | fall
        rise, fall = down | ones & ~(keep | up), up & keep
        rises.append(rise)
        if fitting and score < best:
            best, end = score, j
        # a column more lowers the distance by one at most
        if score - (m - j) > limit and (not fitting or best > limit):
            return None
    if not fitting:
        best = score if m else n
    if best > limit:
        return None
    i, j, ops = n, end, []
    while i > 0 or j > 0:
        if i > 0 and rises[j] >> i - 1 & 1:
            ops.append("D")
            i -= 1
        elif j > 0 and (i == 0 or grows[j] >> i - 1 & 1):
            ops.append("I")
            j -= 1
        else:
            i, j = i - 1, j - 1
            ops.append("M" if query[i] == target[j] else "X")
    return Alignment(compact("".join(reversed(ops))), best, end)


def align_affine(query: bytes, target: bytes, mismatch: int = 2, gap_open: int = 4, gap_extend: int = 1, fitting: bool = True) -> Alignment:
    """Affine gaps (three tables, vectorised by rows); the distance told is that of its CIGAR."""
    n, m = len(query), len(target)
    q, t = np.frombuffer(query, np.uint8), np.frombuffer(target, np.uint8)
    big = 1 << 28
    steps = np.arange(m + 1, dtype=np.int64) * gap_extend
    best = np.empty((n + 1, m + 1), np.int64)
    down = np.full((n + 1, m + 1), big, np.int64)  # ends in a query-only run
    along = np.full((n + 1, m + 1), big, np.int64)  # ends in a target-only run
    along[0, 1:] = gap_open + steps[1:]
    best[0] = along[0]
    best[0, 0] = 0
    for i in range(1, n + 1):
        down[i] = np.minimum(down[i - 1] + gap_extend, best[i - 1] + gap_open + gap_extend)
        diagonal = np.full(m + 1, big, np.int64)
        diagonal[1:] = best[i - 1, :-1] + mismatch * (t != q[i - 1])
        base = np.minimum(down[i], diagonal)
        # a run opens from any earlier cell; opening from within a run never pays
        reach = np.minimum.accumulate(base - steps) + steps + gap_open
        along[i, 1:] = reach[:-1] + gap_extend
        best[i] = np.minimum(base, along[i])
    j = int(m - np.argmin(best[n][::-1])) if fitting else m
    end, i, ops, layer = j, n, [], "best"
    while i > 0 or j > 0:
        if layer == "best":
            v = best[i, j]
            if i > 0 and j > 0 and v == best[i - 1, j - 1] + mismatch * int(t[j - 1] != q[i - 1]):
                i, j = i - 1, j - 1
                ops.append("M" if q[i] == t[j] else "X")
            else:
                layer = "along" if j > 0 and v == along[i, j] else "down"
        elif layer == "along":
            ops.append("I")
            v = along[i, j]
            j -= 1
            if not (j > 0 and along[i, j] + gap_extend == v):
                layer = "best"
        else:
            ops.append("D")
            v = down[i, j]
            i -= 1
            if not (i > 0 and down[i, j] + gap_extend == v):
                layer = "best"
    cigar = compact("".join(reversed(ops)))
    return Alignment(cigar, sum(c != "M" for c in expand(cigar)), end)


def variants_of(cigar: str, start: int, query: str, target: str) -> list[tuple[int, str, str, dict[str, int]]]:
    """(position, kind, ref_base, alleles) of an alignment from target ``start`` on.

    Mismatches give one row a base; a run of target-only bases one deletion at its start,
    unless the query has ended; a run of query-only bases one insertion with its bases counted.
    """
    out = []
    t, q = start, 0
    for op, run in groupby(expand(cigar)):
        size = len(list(run))
        if op == "X":
            out += [(t + i, "snp", target[t + i], {query[q + i]: 1}) for i in range(size)]
        elif op == "I" and q < len(query):
            out.append((t, "deletion", target[t], {".": 1}))
        elif op == "D":
            bases = query[q : q + size]
            out.append((t, "insertion", ".", {b: bases.count(b) for b in sorted(set(bases))}))
        t += size * (op in "MXI")
        q += size * (op in "MXD")
    return out
