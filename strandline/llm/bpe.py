"""Byte-level BPE by backtracking over an Aho-Corasick automaton.

Token bytes are mapped to Latin-1 characters, so that pyahocorasick, which matches
characters, matches bytes. One scan of a pre-token gives the longest token at every
start; the encoder walks left to right from the longest matches and steps back where a
token can't stand beside its left neighbour. Whether two tokens can stand side by side
is memoised. The result equals that of merging by rank, in time linear in the text.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokens up to this many characters are kept in a worker's cache, at most so many.
CACHED_CHARS, CACHED = 40, 600_000
#: Pairs of tokens whose fit is memoised, at most so many; bits of a token's number in a pair.
MEMO, PAIR = 400_000, 32


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def decoder(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {i: b for b, i in ranks.items()}


def decode_ids(bytes_of: dict[int, bytes], ids: bytes | None) -> bytes:
    if not ids:
        return b""
    return b"".join(map(bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


class _Pieces(dict):
    """Pre-tokens and their packed ids: short ones are kept, up to CACHED of them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        got = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = got
        return got


class BytePairCodec:
    """Encodes and decodes with the ranks of a vocabulary file; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = decoder(ranks)
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.auto = ahocorasick.Automaton()
        # single bytes match where they stand; the automaton finds what is longer
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        for b, i in ranks.items():
            if len(b) > 1:
                self.auto.add_word(b.decode("latin-1"), (len(b) - 1, i))
        if len(self.auto):
            self.auto.make_automaton()
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        #: The longest other token that starts a token, or None.
        self.shorter: dict[int, int | None] = {}
        #: A token's last merge, (itself, itself) for what no merge makes; and merges by their parts.
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        #: Whether two tokens, in one number, can stand side by side.
        self.fits: dict[int, bool] = {}
        self.cache = _Pieces(self._packed_piece)
        for i in sorted(self.bytes_of):
            self._learn(i)

    def _learn(self, i: int) -> None:
        b = self.bytes_of[i]
        self.shorter[i] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), None)
        self.halves[i] = (i, i)
        # Only earlier tokens can be the parts of the last merge, and both must already fit.
        for k in range(1, len(b)):
            left, right = self.ranks.get(b[:k]), self.ranks.get(b[k:])
            if left is not None and right is not None and left < i and right < i and self._fit(left, right):
                self.halves[i] = (left, right)
                self.merged[left, right] = i
                self.fits.pop(left << PAIR | right, None)
                break

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank ends in just these two tokens."""
        known = self.fits.get(a << PAIR | b)
        if known is None:
            known = self.fits[a << PAIR | b] = self._compatible(a, b)
            if len(self.fits) > MEMO:
                self.fits.clear()
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the latest merge on either side of the seam; no pair across it may merge earlier.
        limit = 1 << 60
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b:
                limit = a
                a = self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # matches come by their ends, so that the last one of a start is its longest
        best = list(map(self.single.__getitem__, piece))
        if len(self.auto):
            for end, (back, i) in self.auto.iter(piece.decode("latin-1")):
                best[end - back] = i
        open_ = bytearray(b"\x01") * (n + 1)
        size, shorter, fits, fit = self.size, self.shorter, self.fits.get, self._fit
        out: list[int] = []
        pos, token = 0, best[0]
        while pos < n:
            end = pos + size[token]
            if open_[end]:
                if not out:
                    stands = True
                else:
                    last = out[-1]
                    stands = fits(last << PAIR | token)
                    if stands is None:
                        stands = fit(last, token)
                if stands:
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = best[pos]
                    continue
            token = shorter[token]
            while token is None:
                # nothing fits here; shorter forms of what stood before come next
                open_[pos] = 0
                last = out.pop()
                pos -= size[last]
                token = shorter[last]
        return out

    def _packed_piece(self, piece: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.encode_piece(piece.encode("utf-8"))))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text is empty."""
        return b"".join(map(self.cache.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        return decode_ids(self.bytes_of, ids)

    def forget(self) -> None:
        """Drops the memos; the tables stay."""
        self.cache.clear()
        self.fits.clear()


_codecs: dict[tuple[str, str], BytePairCodec] = {}
_decoders: dict[str, dict[int, bytes]] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec per worker process and vocabulary."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = BytePairCodec(load_ranks(path), pattern)
        # the tables stay as long as the worker: the collector need not walk them again and again
        gc.collect()
        gc.freeze()
    return _codecs[key]


def decoding(path: str):
    """Decoding needs the tokens' bytes only, so its workers build no automaton."""
    if path not in _decoders:
        _decoders[path] = decoder(load_ranks(path))
    return partial(decode_ids, _decoders[path])


def _mapped(df: DataFrame, source: str, targets: tuple[str, ...], function, after=lambda: None, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds binary columns ``targets``; function() gives what makes a value's tuple of them."""
    keep = df.drop(*(t for t in targets if t != source))
    stay = [i for i, f in enumerate(keep.schema.fields) if f.name not in without]
    schema = T.StructType([*(keep.schema.fields[i] for i in stay), *(T.StructField(t, T.BinaryType()) for t in targets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for batch in batches:
            at = batch.schema.get_field_index(source)
            made = [apply(v.as_py()) for v in batch.column(at)]
            columns = [pa.array([m[i] for m in made], pa.binary()) for i in range(len(targets))]
            yield pa.RecordBatch.from_arrays([*(batch.columns[i] for i in stay), *columns], names=[f.name for f in schema.fields])
        after()

    return keep.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds column ``ids``: binary, the token ids as little-endian unsigned 32-bit integers.

    Narrow: no shuffle, each text whole. Null or empty texts give empty ids. A column of
    the same name is replaced; other columns, repeated rows and their order stay.
    """
    # workers outlive their tasks, and other stages' tasks need the memory
    return _mapped(df, text, (ids,), lambda: _each(codec(path, pattern).encode), lambda: codec(path, pattern).forget())


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds column ``decoded``: the bytes of the ids (binary). Unknown ids raise KeyError."""
    return _mapped(df, ids, (decoded,), lambda: _each(decoding(path)))


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", without: tuple[str, ...] = ()) -> DataFrame:
    """``encode``, then ``decode`` of its ids, by one worker a task where the two apart take two.

    Columns named in ``without`` (the text, say) are read but do not come back.
    """

    def both():
        own = codec(path, pattern)

        def apply(value):
            made = own.encode(value)
            return made, own.decode(made)

        return apply

    return _mapped(df, text, (ids, decoded), both, lambda: codec(path, pattern).forget(), without)


def _each(function):
    return lambda value: (function(value),)
