"""Readers of sequence files: FASTA, FASTQ, BAM, AB1, SFF, plain or gzipped.

Files are read whole by Spark's binaryFile source, one file a row, so that any store that
Spark reads will do; a file is one task's work, as its compression is not splittable. Large
plain FASTA is read by `read_fasta_text` instead, whose records split.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE = "file string, seq_idx bigint, id string, description string, bases string, quality array<smallint>, mapq smallint, mate_id string, proper_pair boolean, insert_size int, is_first boolean, is_second boolean, mate_mapped boolean"
_NAMES = [x.split()[0] for x in SEQUENCE.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int16()), pa.int16(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]


class InvalidFormat(ValueError):
    pass


def sniff(path: str, data: bytes) -> str:
    """The format by extension, then by the first bytes; '' for an empty file."""
    name = path.lower()
    if name.endswith(".ab1") or data[:4] == b"ABIF":
        return "ab1"
    if name.endswith(".sff") or data[:4] == b".sff":
        return "sff"
    if name.endswith(".bam"):
        return "bam"
    if name.endswith(".cram") or data[:4] == b"CRAM":
        raise InvalidFormat(f"{path}: CRAM is not supported, with or without an external reference; convert it to BAM")
    first = data[:1]
    if not data:
        return ""
    if first == b">":
        return "fasta"
    if first == b"@":
        return "fastq"
    raise InvalidFormat(f"{path}: neither FASTA nor FASTQ")


def _header(line: str) -> tuple[str, str | None]:
    words = line.split()
    return (words[0] if words else "", " ".join(words[1:]) or None)


def fasta(text: str) -> Iterator[tuple]:
    """A header without a body gives an empty record, but not at the end of the file."""
    head, body = None, []
    for line in text.splitlines():
        if line.startswith(">"):
            if head is not None:
                yield (*_header(head), "".join(body), None)
            head, body = line[1:], []
        elif head is not None:
            body.append(line.strip())
    if head is not None and any(body):
        yield (*_header(head), "".join(body), None)


def fastq(text: str) -> Iterator[tuple]:
    """Records of four lines; qualities are the bytes as they stand, without an offset taken off."""
    lines = text.splitlines()
    at = 0
    while at < len(lines) and lines[at].startswith("@"):
        if at + 3 >= len(lines):
            raise InvalidFormat("a FASTQ record is cut short")
        bases, quality = lines[at + 1].strip(), lines[at + 3].strip()
        if not lines[at + 2].startswith("+"):
            raise InvalidFormat("a FASTQ record lacks its + line")
        if len(bases) != len(quality):
            raise InvalidFormat("a FASTQ record has unequal bases and qualities")
        yield (*_header(lines[at][1:]), bases, [ord(c) for c in quality])
        at += 4


_BAM_BASES = "=ACMGRSVTWYHKDBN"


def bam(data: bytes) -> Iterator[tuple]:
    """Every record, mapped or not, with its mate's flags; BGZF is a series of gzip members."""
    raw = gzip.decompress(data)
    if raw[:4] != b"BAM\1":
        raise InvalidFormat("not a BAM file")
    (size,) = struct.unpack_from("<i", raw, 4)
    at = 8 + size
    (refs,) = struct.unpack_from("<i", raw, at)
    at += 4
    for _ in range(refs):
        (size,) = struct.unpack_from("<i", raw, at)
        at += 8 + size
    while at + 4 <= len(raw):
        (size,) = struct.unpack_from("<i", raw, at)
        if at + 4 + size > len(raw):
            raise InvalidFormat("a BAM record is cut short")
        _, _, name_len, mapq, _, n_cigar, flags, n, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", raw, at + 4)
        p = at + 36
        name = raw[p : p + name_len - 1].decode()
        p += name_len + 4 * n_cigar
        packed = raw[p : p + (n + 1) // 2]
        bases = "".join(_BAM_BASES[b >> 4] + _BAM_BASES[b & 15] for b in packed)[:n]
        p += (n + 1) // 2
        quality = list(raw[p : p + n])
        mate = (None,) * 6
        if flags & 0x1:
            bare = name
            while bare.endswith("/1"):
                bare = bare[:-2]
            while bare.endswith("/2"):
                bare = bare[:-2]
            mate = (bare + ("/2" if flags & 0x40 else "/1"), bool(flags & 0x2), tlen, bool(flags & 0x40), bool(flags & 0x80), not flags & 0x8)
        yield (name, None, bases, None if quality and quality[0] == 0xFF else quality, None if mapq == 255 else mapq, *mate)
        at += 4 + size


def ab1(path: str, data: bytes) -> Iterator[tuple]:
    """One record named after the file: called bases, and their qualities where present."""
    if data[:4] != b"ABIF":
        raise InvalidFormat("not an ABIF file")
    count, = struct.unpack_from(">i", data, 18)
    start, = struct.unpack_from(">i", data, 26)
    found: dict[str, bytes] = {}
    for i in range(count):
        name, number, _, _, _, size, offset, _ = struct.unpack_from(">4sihhiiii", data, start + 28 * i)
        where = start + 28 * i + 20 if size <= 4 else offset
        if where + size > len(data):
            raise InvalidFormat("an ABIF entry lies outside the file")
        found.setdefault(name.decode("latin-1"), data[where : where + size])
    bases = found.get("PBAS", b"").decode("latin-1")
    if not bases:
        raise InvalidFormat("an ABIF file without called bases")
    quality = found.get("PCON")
    if quality is not None and len(quality) != len(bases):
        raise InvalidFormat("an ABIF file has unequal bases and qualities")
    yield (path.rsplit("/", 1)[-1].rsplit(".", 1)[0], None, bases, list(quality) if quality is not None else None)


def sff(data: bytes) -> Iterator[tuple]:
    """Reads of a flowgram file, cut at the right by the smaller clip that is set."""
    if data[:4] != b".sff":
        raise InvalidFormat("not an SFF file")
    _, _, index_at, index_len, reads, head, _, flows, _ = struct.unpack_from(">IIQIIHHHB", data)
    at = head
    for _ in range(reads):
        if index_at and at == index_at:
            at += index_len + -index_len % 8
        size, name_len, n, _, right_q, _, right_a = struct.unpack_from(">HHIHHHH", data, at)
        name = data[at + 16 : at + 16 + name_len].decode()
        at += size
        body = at + 2 * flows + n
        bases = data[body : body + n].decode()
        quality = list(data[body + n : body + 2 * n])
        if len(quality) < n:
            raise InvalidFormat("an SFF read is cut short")
        used = 2 * flows + 3 * n
        at += used + -used % 8
        end = min([c for c in (right_q, right_a) if c] or [n])
        yield (name, None, bases[:end], quality[:end])


def records(path: str, data: bytes) -> Iterator[tuple]:
    if path.lower().endswith(".gz") and data[:2] == b"\x1f\x8b":
        data, path = gzip.decompress(data), path[:-3]
    kind = sniff(path, data)
    if kind == "bam":
        yield from bam(data)
    elif kind == "ab1":
        yield from ab1(path, data)
    elif kind == "sff":
        yield from sff(data)
    elif kind:
        yield from (fasta if kind == "fasta" else fastq)(data.decode())


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """SEQUENCE rows of all files under ``path``, numbered within their file; any known format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for i, r in enumerate(records(name, data.as_py())):
                    rows.append((name, i, *r, *(None,) * (11 - len(r))))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SEQUENCE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_fasta_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, bases) of plain or gzipped FASTA, split at records by native functions."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("v"))
    head = F.trim(F.regexp_extract("v", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s", "")
    words = F.split(head, r"\s+")
    return rows.filter(F.trim("v") != "").select(words[0].alias("id"), F.nullif(F.array_join(F.slice(words, 2, 1 << 20), " "), F.lit("")).alias("description"), body.alias("bases"))
