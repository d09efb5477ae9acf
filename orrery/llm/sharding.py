"""Sharding by rendezvous hashing, with DataFrame functions only.

Every record goes to the shard with the best score of (key, shard), so that one more shard takes records only into
itself and one fewer gives up only its own: of n records about n / shards move. Weights follow the logarithmic method:
shard s wins with probability w_s / sum(w).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that one task numbers, on average.
SLOT_ROWS = 20_000


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Number of the winning shard. Ties go to the smaller number; a null key is a key like any other.

    A shard with weight 0 gets nothing; at least one weight must be positive.
    """
    live = [(s, float(w)) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")

    def cost(s: int, w: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(s), F.lit(seed)), 11)
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(2.0**53)) / F.lit(w)).alias("cost"), F.lit(s).alias("shard"))

    return F.array_min(F.array(*[cost(s, w) for s, w in live])).getField("shard")


def shard(df: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, seed: int = 0, out: str = "shard") -> DataFrame:
    """``df`` with the column ``out``; no shuffle. The key decides alone, so that equal keys share a shard."""
    return df.withColumn(out, rendezvous(F.col(key), weights or [1.0] * shards, seed))


def with_slots(df: DataFrame, key: str, shard_col: str = "shard", out: str = "slot") -> DataFrame:
    """Number the rows of each shard without gaps from 0.

    A shard may hold a great part of all rows, so a task numbers one hash bucket of a shard and the buckets' counts give
    its first number. Rows of one bucket are ordered by the key and then by all other columns; fully equal rows are
    interchangeable. The rows are read twice; callers hand in something cheap to read.
    """
    rows = df.count()
    buckets = 1 << max(0, (rows // SLOT_ROWS).bit_length())
    with_b = df.withColumn("__b", F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(buckets)).cast("int"))
    counts = with_b.groupBy(shard_col, "__b").count()
    before = Window.partitionBy(shard_col).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard_col).alias("__s"), F.col("__b").alias("__b2"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard_col, "__b").orderBy(key, *[c for c in df.columns if c not in (key, shard_col)])
    numbered = with_b.withColumn("__n", F.row_number().over(inside) - 1)
    joined = numbered.join(first, (F.col(shard_col) == F.col("__s")) & (F.col("__b") == F.col("__b2")))
    return joined.select(*[F.col(c) for c in df.columns], (F.col("__first") + F.col("__n")).cast("long").alias(out))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of sharding ``docs`` (doc_id, text, anything): law `key`.

    Null and empty texts have size 1 and checksum 0; repeated doc_ids share a shard and get slots of their own; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    narrow = common.cut(narrow.transform(shard, "doc_id", shards))
    grown = shard(narrow, "doc_id", shards + 1, out="grown_shard")
    return with_slots(grown, "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
