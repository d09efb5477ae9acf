"""Structured Streaming forms of the operation log and of evidence logs.

A fold of last writers commutes, so late operations need no watermark for right results; state only expires by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

STATE = "clock long, nonce string, priority long, n long"
OUT = "item long, clock long, nonce string, priority long, n long"


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files at ``path``, a file or a folder; a pattern stands for it, since a stream's path may not be a plain file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def fold_stream(ops: DataFrame) -> DataFrame:
    """OUT: after each batch the new state of every item it touches: its last priority and number of operations."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, nonce, priority, n = state.get if state.exists else (-1, "", 0, 0)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["clock", "nonce"]).iloc[-1]
            if (int(top["clock"]), top["nonce"]) > (clock, nonce):
                clock, nonce, priority = int(top["clock"]), top["nonce"], int(top["priority"])
        state.update((clock, nonce, priority, n))
        yield pd.DataFrame({"item": [key[0]], "clock": [clock], "nonce": [nonce], "priority": [priority], "n": [n]})

    return ops.select("item", "clock", "nonce", "priority").groupBy("item").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def evidence_stream(rows: DataFrame, delay: str = "2 days") -> DataFrame:
    """(sha, day, n): distinct observations by commit and day; repeats within ``delay`` count once."""
    seen = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha", "observation"])
    return seen.groupBy(F.window("ts", "1 day"), "sha").agg(F.count("*").alias("n")).select("sha", F.to_date("window.start").alias("day"), "n")


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run what is there through ``stream`` into Parquet below ``folder`` and read it; each batch is its own folder, so a repeated one is replaced."""
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")
