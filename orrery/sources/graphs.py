"""Stored graphs: Parquet partitioned by build, replaced build by build."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder of spark.checkpoint.dir, or in the session's own where it is unset."""
    from orrery.operators.closure import cut

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        cut(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(rows: DataFrame, folder: str, key: str) -> None:
    """Write ``rows``; a ``key`` value that is stored already is replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def newest(spark: SparkSession, folder: str, key: str, before: str | None = None) -> DataFrame:
    """The rows of the largest ``key``, below ``before`` if given; only that folder is read."""
    stored = spark.read.parquet(folder)
    keys = stored.select(key).distinct()
    if before is not None:
        keys = keys.where(F.col(key) < before)
    last = keys.agg(F.max(key)).first()[0]
    return stored.where(F.col(key) == F.lit(last))


def unseen(rows: DataFrame, stored: DataFrame, digest: str) -> DataFrame:
    """``rows`` whose content isn't stored under its digest yet."""
    return rows.join(stored.select(digest).distinct(), digest, "left_anti")


def upsert(cache: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``cache`` with ``rows`` in place of those of the same key."""
    return cache.join(rows.select(key), key, "left_anti").unionByName(rows)


def stale(sources: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """(key) of sources that the cache lacks, or has with another mtime."""
    return sources.select(key, "mtime").join(cache.select(key, "mtime"), [key, "mtime"], "left_anti").select(key)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, digest) of all files below a folder of any file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("digest"))


def write_csv(rows: DataFrame, folder: str) -> None:
    """With a header; nulls are empty."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(folder)
