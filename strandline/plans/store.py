"""Plans, observations and query indexes as Parquet datasets, with their readers and writers."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN_VERSION, OBSERVATIONS_VERSION = 1, 1


def timestamp(now: str | None = None) -> str:
    """RFC 3339; a given text or SOURCE_DATE_EPOCH makes outputs reproducible."""
    if now:
        return now
    epoch = os.environ.get("SOURCE_DATE_EPOCH")
    at = datetime.fromtimestamp(int(epoch), timezone.utc) if epoch else datetime.now(timezone.utc)
    return at.isoformat()


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or the warehouse without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _meta(spark: SparkSession, path: str, data: dict) -> None:
    spark.createDataFrame([(json.dumps(data, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def _check(spark: SparkSession, path: str, version: int) -> dict:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    if meta.get("version") != version:
        raise ValueError(f"{path}: version {meta.get('version')}, not {version}")
    return meta


def write_plan(path: str, tables: dict[str, DataFrame], meta: dict | None = None) -> None:
    """One folder per table; tables with chunk_id are partitioned by it and sorted within."""
    for name, df in tables.items():
        w = df
        if "chunk_id" in df.columns:
            w = df.repartition("chunk_id").sortWithinPartitions("chunk_id", *[c for c in df.columns if c != "chunk_id"])
            w.write.mode("overwrite").partitionBy("chunk_id").parquet(f"{path}/{name}")
        else:
            w.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    _meta(spark, path, {"version": PLAN_VERSION, "tables": sorted(tables), **(meta or {})})


def read_contents(spark: SparkSession, path: str) -> dict:
    """What a plan holds, without opening its tables: version, names and what its writer added."""
    return _check(spark, path, PLAN_VERSION)


def read_plan(spark: SparkSession, path: str, worker: int | None = None, only: tuple[str, ...] | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(meta, tables), or only the tables named; with a worker only its chunk, which prunes to one folder."""
    meta = read_contents(spark, path)
    missing = set(only or ()) - set(meta["tables"])
    if missing:
        raise ValueError(f"{path}: no tables {sorted(missing)}")
    tables = {}
    for name in only if only is not None else meta["tables"]:
        df = spark.read.parquet(f"{path}/{name}")
        tables[name] = df.filter(F.col("chunk_id") == worker) if worker is not None and "chunk_id" in df.columns else df
    return meta, tables


def write_observations(obs: DataFrame, coverage: DataFrame, path: str, reference_length: int, sample_id: str, now: str | None = None) -> None:
    obs.write.mode("overwrite").parquet(f"{path}/observations")
    coverage.write.mode("overwrite").parquet(f"{path}/coverage")
    _meta(obs.sparkSession, path, {"version": OBSERVATIONS_VERSION, "reference_length": reference_length, "sample_id": sample_id, "timestamp": timestamp(now)})


def read_observations(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    meta = _check(spark, path, OBSERVATIONS_VERSION)
    return meta, spark.read.parquet(f"{path}/observations"), spark.read.parquet(f"{path}/coverage")


def write_filtered(spark: SparkSession, path: str, keep, out: str) -> None:
    """Observations that ``keep`` (a Column) lets pass, with the coverage, the reference's length,
    the sample and the timestamp of the original."""
    meta, obs, coverage = read_observations(spark, path)
    write_observations(obs.filter(keep), coverage, out, meta["reference_length"], meta["sample_id"], meta["timestamp"])


def query_index(placements: DataFrame, least: float = 0.95) -> DataFrame:
    """Placements of enough score, each query's together and ordered; queries left empty have no rows."""
    return placements.filter(F.col("score") >= least).repartition("query_id").sortWithinPartitions("query_id", "pos", F.col("score").desc())


def cross_space_index(placements: DataFrame, least: float = 0.95) -> DataFrame:
    return placements.filter(F.col("identity") >= least).repartition("query_id").sortWithinPartitions("query_id", "space", "pos", F.col("identity").desc())


def write_queries(index: DataFrame, path: str) -> None:
    """An index of either kind, as `query_index` or `cross_space_index` orders it."""
    index.write.mode("overwrite").parquet(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return _index(spark, path, {"query_id", "pos", "score"})


def read_cross_space_queries(spark: SparkSession, path: str) -> DataFrame:
    return _index(spark, path, {"query_id", "space", "pos", "identity"})


def _index(spark: SparkSession, path: str, needs: set[str]) -> DataFrame:
    df = spark.read.parquet(path)
    if not needs <= set(df.columns):
        raise ValueError(f"{path}: no such index, it lacks {sorted(needs - set(df.columns))}")
    return df


def write_tasks(tasks: DataFrame, path: str) -> None:
    tasks.select("query_id", "target_id").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
