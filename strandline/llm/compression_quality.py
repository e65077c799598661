"""Compression classifier: two zstandard dictionaries, one of good and one of bad text.

A text that the good dictionary shortens more than the bad one resembles good text. The
feature is the difference of the two compressed sizes over the size without a dictionary;
logistic regression on the labelled sample turns it into a probability. Text that repeats
itself needs no dictionary, and its difference says nothing; so the regression also sees how
far the text shrinks without one, as the logarithm of that size over the text's.

Sizes are of windows of 1 KB, so that a long text does not drown its dictionary; all windows
of a text count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import logistic_fit, sigmoid


#: Bytes that are compressed together.
WINDOW = 1024


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # of the difference, of the shrinkage, and the intercept
    level: int = 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of each label, those of the least hashes of their ids.

    A bounded sample: the documented parameter per_class bounds the ids and, by itself, the
    texts that reach the driver; top-k by hash takes the same rows at any partitioning. Where
    rows repeat an id, its least text counts, once. Null ids, labels and texts are left out,
    and a row labelled both ways is a row of each label.
    """
    rows = []
    known = labels.select(F.col("doc_id"), F.col(label).alias("__y")).filter(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    texts = docs.select("doc_id", "text").filter("text is not null")
    for y in (0, 1):
        key = F.xxhash64(F.lit(seed), "doc_id")
        # ids first, so that only the chosen texts move
        ids = [r[0] for r in known.filter(F.col("__y") == y).select("doc_id").orderBy(key, "doc_id").limit(per_class).collect()]
        if ids:
            picked = texts.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text"))
            rows += [(r[0], y) for r in picked.orderBy("doc_id").select("text").collect()]
    return rows


def _dictionary(texts: list[bytes], size: int):
    import zstandard

    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:size]  # too few samples: their bytes serve as the dictionary


class _Sizes:
    def __init__(self, good: bytes, bad: bytes, level: int):
        import zstandard as z

        plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        make = lambda d: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), **plain) if d else z.ZstdCompressor(**plain)
        self.good, self.bad, self.none = make(good), make(bad), z.ZstdCompressor(**plain)

    def features(self, text: str | None) -> tuple[float, float]:
        """(bad - good) / plain of the compressed sizes, and log(plain / bytes); zeros without a text."""
        raw = (text or "").encode("utf-8")
        if not raw:
            return 0.0, 0.0
        plain = good = bad = 0
        for at in range(0, len(raw), WINDOW):
            part = raw[at : at + WINDOW]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
            plain += len(self.none.compress(part))
        return (bad - good) / plain, math.log(plain / len(raw))


def probability(features: tuple[float, float], weights: tuple[float, float, float]) -> float:
    return sigmoid(features[0] * weights[0] + features[1] * weights[1] + weights[2])


def fit(sample: list[tuple[str, int]], dict_bytes: int = 65_536, level: int = 3) -> CompressionModel:
    """Half of each label makes its dictionary, the other half fits the regression.

    Without rows of a label its dictionary is empty, and the score is the base rate of the rest.
    """
    by_label = [[s for s in sample if s[1] == y] for y in (0, 1)]
    first = [s for part in by_label for s in part[::2]]
    second = [s for part in by_label for s in part[1::2]]
    # whole texts, in samples of up to 8 KB
    cut = lambda y: [raw[at : at + 8192] for raw in (t.encode("utf-8") for t, v in first if v == y) for at in range(0, len(raw), 8192)]
    good, bad = _dictionary(cut(1), dict_bytes), _dictionary(cut(0), dict_bytes)
    sizes = _Sizes(good, bad, level)
    scale = np.array([10.0, 1.0])  # differences are a few hundredths
    x = np.array([sizes.features(t) for t, _ in second]).reshape(len(second), 2) * scale
    w = logistic_fit(x, np.array([v for _, v in second]))
    return CompressionModel(good, bad, (*map(float, w[:2] * scale), float(w[2])), level)


def score(df: DataFrame, model: CompressionModel, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: the probability of good quality. Null and empty texts are
    scored as features of 0; equal texts get equal scores.

    Narrow, whole texts; the model (two dictionaries of fixed size) travels with the tasks.
    A column named ``out`` is replaced, others stay; an empty table gives an empty one.
    """
    keep = df.drop(out)
    schema = T.StructType([*keep.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model.good, model.bad, model.level)
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            made = [probability(sizes.features(v.as_py()), model.weights) for v in col]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.float64())], names=[f.name for f in schema.fields])

    return keep.mapInArrow(run, schema)
