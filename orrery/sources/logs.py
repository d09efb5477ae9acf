"""Text, JSON-lines and XML logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DURATION = r"^\s*([0-9]+\.[0-9]+)s\s+(setup|call|teardown)\s+(\S.*?)\s*$"


def durations(lines: DataFrame) -> DataFrame:
    """(test, setup, call, teardown) of a log's lines (value), sums of seconds; other lines are skipped."""
    part = lambda k: F.regexp_extract("value", _DURATION, k)
    rows = lines.where(F.col("value").rlike(_DURATION)).select(part(3).alias("test"), part(2).alias("phase"), part(1).cast("double").alias("s"))
    return rows.groupBy("test").agg(*[F.round(F.sum(F.when(F.col("phase") == p, F.col("s"))), 4).alias(p) for p in ("setup", "call", "teardown")])


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    return durations(spark.read.text(path))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only log; lines that aren't JSON objects of the schema are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return rows.where("_bad is null").drop("_bad")


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Append rows with their keys in order of name."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """(test, failed) of JUnit XML files: classname::name of every case."""
    schema = "_classname string, _name string, failure string, error string"
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    return rows.select(F.concat_ws("::", "_classname", "_name").alias("test"), (F.col("failure").isNotNull() | F.col("error").isNotNull()).alias("failed"))


def write_junit(cases: DataFrame, path: str) -> None:
    """JUnit XML of (classname, name, failed): a suite for each part of the rows."""
    failure = F.when(F.col("failed"), F.struct(F.lit("assertion").alias("_message"), F.lit("failed").alias("_VALUE")))
    out = cases.select(F.col("classname").alias("_classname"), F.col("name").alias("_name"), failure.alias("failure"))
    out.write.format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").save(path)
