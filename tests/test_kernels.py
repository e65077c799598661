"""Kernels by brute force, replay and hand cases."""

import random

import pytest

from strandline.operators import kernels as k
from strandline.operators.intervals import find_repeats
from strandline.operators.sketch import minimizers
from strandline.sources import records


def distance(a, b):
    row = list(range(len(b) + 1))
    out = [row]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
        out.append(row)
    return out[-1]


def replay(cigar, q, t):
    i = j = edits = 0
    for op in k.expand(cigar):
        if op in "MX":
            assert (q[i] == t[j]) == (op == "M")
        edits += op != "M"
        i += op in "MXD"
        j += op in "MXI"
    return i, j, edits


@pytest.mark.parametrize("seed", range(60))
def test_alignments(seed):
    r = random.Random(seed)
    t = "".join(r.choice("ACGT") for _ in range(r.randint(0, 40))).encode()
    q = bytearray(t[: r.randint(0, len(t))])
    for _ in range(r.randint(0, 6)):
        at = r.randint(0, len(q))
        if r.random() < 0.4 and at < len(q):
            del q[at]
        else:
            q.insert(at, ord(r.choice("ACGT")))
    q = bytes(q)
    last = distance(q, t)
    for fitting, want in ((True, min(last)), (False, last[-1])):
        for a in (k.align_rows(q, t, fitting), k.align_wavefront(q, t, fitting), k.align_affine(q, t, fitting=fitting)):
            i, j, edits = replay(a.cigar, q, t)
            assert (i, j, edits) == (len(q), a.target_end, a.edit_distance)
            assert fitting or j == len(t)
        assert k.align_rows(q, t, fitting).edit_distance == want
        assert k.align_wavefront(q, t, fitting).edit_distance == want
    assert k.align_wavefront(b"AAAA", b"TTTT", False, 2) is None


@pytest.mark.parametrize("seed", range(20))
def test_bit_vectors_give_the_rows_path(seed):
    r = random.Random(seed)
    for _ in range(60):
        q = bytes(r.choice(b"ACG") for _ in range(r.randint(0, 20)))
        t = bytes(r.choice(b"ACG") for _ in range(r.randint(0, 25)))
        for fitting in (True, False):
            whole = k.align_rows(q, t, fitting)
            assert k.align_bits(q, t, fitting) == whole
            short = k.align_bits(q, t, fitting, 3)
            assert short == whole if whole.edit_distance <= 3 else short is None


def test_chains_look_back_past_losers():
    """A predecessor that has lost often counts against the search; others don't."""
    p = k.ChainParams(max_skip=1)
    seeds = [(0, 0)] + [(40 - i, 41 + i) for i in range(8)] + [(60, 60)]
    (score, path), *_ = k.chain_seeds(seeds, p)
    assert score >= 42 and path[-1] == (60, 60)
    # two chains that share a beginning: the second keeps the score of its end
    fork = [(0, 0), (30, 30), (60, 60), (62, 90)]
    chains = k.chain_seeds(fork)
    assert chains[0][1] == [(0, 0), (30, 30), (60, 60)] and all(c[0] >= 25 for c in chains)


def test_md5_of_rows_and_minimizers():
    import hashlib

    import numpy as np

    from strandline.operators.sketch import md5_rows

    for size in (0, 1, 21, 55):
        rows = np.frombuffer(random.Random(size).randbytes(size * 9), np.uint8).reshape(9, size)
        assert [x.tobytes().hex() for x in md5_rows(rows)] == [hashlib.md5(x.tobytes()).hexdigest() for x in rows]


def test_affine_cost_is_least():
    r = random.Random(9)
    for _ in range(40):
        q = bytes(r.choice(b"AC") for _ in range(r.randint(1, 7)))
        t = bytes(r.choice(b"AC") for _ in range(r.randint(1, 7)))

        def cost(cigar):
            from itertools import groupby

            return sum({"M": 0, "X": 2 * n}.get(op, 4 + n) for op, n in ((o, len(list(g))) for o, g in groupby(k.expand(cigar))))

        def every(i, j):
            if i == len(q) and j == len(t):
                yield ""
            if i < len(q) and j < len(t):
                for x in every(i + 1, j + 1):
                    yield ("M" if q[i] == t[j] else "X") + x
            if i < len(q):
                for x in every(i + 1, j):
                    yield "D" + x
            if j < len(t):
                for x in every(i, j + 1):
                    yield "I" + x

        if len(q) + len(t) <= 9:
            assert cost(k.align_affine(q, t, fitting=False).cigar) == min(map(cost, every(0, 0)))


def test_chains():
    line = [(i * 30, 1000 + i * 30) for i in range(6)]
    (score, path), *rest = k.chain_seeds(line + [(10, 5000)])
    assert path == line and score == 21 * 6 and rest == []
    assert k.target_start(path) == 1000
    assert k.chain_seeds([(5, 5)]) == []


def test_variants():
    got = k.variants_of("2M1X2I1M2D1M", 3, "ACTGCCA", "NNNACGTTGA")
    assert got == [(5, "snp", "G", {"T": 1}), (6, "deletion", "T", {".": 1}), (9, "insertion", ".", {"C": 2})]


def test_prefix_and_cigar():
    assert k.matching_prefix(b"ACGTA", b"ACGA") == 3 and k.matching_prefix(b"", b"A") == 0
    assert k.compact("MMXXMI") == "2M2X1M1I" and k.expand("M2X") == "MXX"


def test_repeats():
    assert find_repeats("at" * 5) == [(0, 9, 2, "AT")] or find_repeats("at" * 5)[0][2] in (2, 4)
    assert find_repeats("GG" + "CAG" * 4) [0][2] == 3
    assert find_repeats("GATAGATAGATA")[0] == (0, 11, 4, "GATA")
    assert find_repeats(None) == []


def test_minimizers_hold_their_laws():
    r = random.Random(4)
    s = "".join(r.choice("ACGT") for _ in range(400))
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for order in ("poly", "md5"):
        h, p = minimizers(s, 21, 11, True, order)
        assert set(h) == set(minimizers(rc, 21, 11, True, order)[0])
        assert all(b - a <= 11 for a, b in zip(p, p[1:])) and p[0] < 11
    assert minimizers("ACGT", 21, 11)[0] == []


def test_text_formats():
    assert list(records.fasta(">a  x y\nAC\nGT\n>b\n>c\nT\n>d\n")) == [("a", "x y", "ACGT", None), ("b", None, "", None), ("c", None, "T", None)]
    assert list(records.fastq("@r d\nAC\n+\nI!\n")) == [("r", "d", "AC", [73, 33])]
    for bad in ("@r\nAC\n+\nI\n", "@r\nAC\n"):
        with pytest.raises(records.InvalidFormat):
            list(records.fastq(bad))
    assert records.sniff("x.fa", b"") == ""
    with pytest.raises(records.InvalidFormat):
        records.sniff("x.txt", b"hello")


def test_bam_ab1_sff():
    import gzip
    import struct

    name, bases = b"r/1\0", bytes([0x12, 0x48])
    body = struct.pack("<iiBBHHHiiii", 0, 5, len(name), 30, 0, 0, 0x1 | 0x2 | 0x40, 4, 0, 9, -250) + name + bases + bytes([9, 8, 7, 6])
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    assert list(records.bam(gzip.compress(raw))) == [("r/1", None, "ACGT", [9, 8, 7, 6], 30, "r/2", True, -250, True, False, True)]
    head = struct.pack(">4sh4sihhiiii", b"ABIF", 101, b"tdir", 1, 1023, 28, 2, 56, 128, 0)
    data = head.ljust(128, b"\0") + struct.pack(">4sihhii4si", b"PBAS", 1, 2, 1, 4, 4, b"ACGT", 0) + struct.pack(">4sihhii4si", b"PCON", 1, 2, 1, 4, 4, bytes([1, 2, 3, 4]), 0)
    assert list(records.ab1("d/x.ab1", data)) == [("x", None, "ACGT", [1, 2, 3, 4])]
    common = struct.pack(">4sIQIIHHHB", b".sff", 1, 0, 0, 1, 40, 4, 2, 1).ljust(40, b"\0")
    read = struct.pack(">HHIHHHH", 24, 2, 4, 1, 3, 0, 0) + b"rd"
    payload = bytes(4) + bytes(4) + b"ACGT" + bytes([5, 6, 7, 8])
    assert list(records.sff(common + read.ljust(24, b"\0") + payload)) == [("rd", None, "ACG", [5, 6, 7])]
