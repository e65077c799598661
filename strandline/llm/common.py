"""Shared helpers: words, held-out folds, checkpoints, deterministic bounded samples."""

from __future__ import annotations

import gc
import re
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SPLIT = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_TABLE = str.maketrans(_UPPER, _UPPER.lower())


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only; other letters keep their case."""
    return text.lower() if text.isascii() else text.translate(_LOWER_TABLE)


def lower_words(text: pa.Scalar) -> list[bytes]:
    """The contracts' words of an Arrow string, A-Z in lower case, as UTF-8; none for null.

    Of bytes, split() takes the ASCII white space for gaps and lower() only A-Z: just what the
    pattern and `ascii_lower` do, several times as fast.
    """
    raw = text.as_buffer()
    return raw.to_pybytes().lower().split() if raw is not None else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def fold(id_col: str | Column, k: int) -> Column:
    """crc32(id as text) mod k; a null id counts as remainder -1, in no fold."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(k), F.lit(-1))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in spark.checkpoint.dir, which executors share.

    Where the session has no such folder, a local master gets one; on a cluster, whose
    executors could not read it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-checkpoint-"))
    return df.checkpoint(eager=True)


#: Keys of more than one row in so many are joined by broadcast; there are fewer of them than this.
HOT_SHARE = 2000


def spread_join(rows: DataFrame, about: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``about``, which has one row a key and the key's number of rows
    in ``count``, summing to ``total`` at most. Rows of frequent keys and of none stay where they are."""
    hot = F.broadcast(about.filter(F.col(count) * HOT_SHARE > total))
    still = rows.join(hot, key, "left").filter(F.col(key).isNull() | F.col(count).isNotNull())
    dealt = rows.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").join(about, key, "left")
    return still.unionByName(dealt)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nobody holds any more. Its cleaner acts
    when the driver collects garbage, which a small heap of plans may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in few bytes; `unpacked` gives them back."""
    import zstandard

    head = struct.pack("<H", len(arrays))
    body = b""
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode().ljust(4)
        # bytes of equal weight stand together: sorted or small numbers shrink well
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        body += struct.pack("<4sI", code, len(a)) + raw
    return zstandard.compress(head + body, 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    (count,) = struct.unpack_from("<H", raw)
    at, out = 2, []
    for _ in range(count):
        code, n = struct.unpack_from("<4sI", raw, at)
        at += 8
        kind = np.dtype(code.strip().decode())
        size = n * kind.itemsize
        out.append(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.empty(0, kind))
        at += size
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest type that holds them."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton steps for ridge logistic regression; the last weight is the intercept.

    Without both classes the intercept gives the smoothed base rate.
    """
    x = np.asarray(x, float)
    x = x.reshape(len(y), x.shape[1] if x.ndim == 2 else 1)
    y = np.asarray(y, float)
    xb = np.hstack([x, np.ones((len(y), 1))])
    w = np.zeros(xb.shape[1])
    p0 = (y.sum() + 0.5) / (len(y) + 1.0)
    w[-1] = np.log(p0 / (1 - p0))
    if len(y) == 0 or y.min() == y.max():
        return w
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        grad = xb.T @ (p - y) + reg * w
        hess = (xb * (p * (1 - p))[:, None]).T @ xb + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: float) -> float:
    z = min(30.0, max(-30.0, z))
    return float(1 / (1 + np.exp(-z)))
