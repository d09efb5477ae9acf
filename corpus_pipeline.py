"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. ``run`` writes every stage's
rows as Parquet into the shared folder and reads them again, so that a lost executor repeats one stage at most.

Each stage takes tables with further columns, whose names may be those of its own results, and keeps them. Rows with null or
empty texts are neither toxic, nor copies, nor contaminated; they pass. Rows without a doc_id pass the stages that decide by
doc_id (near duplicates, decontamination); rows that repeat a doc_id are decided together. Ties go to the smaller doc_id.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common, decontam, forest, mixing, sharding, toxicity

SHARDS = 8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return toxicity.reject(docs, common.load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8."""
    gone = common.cut(forest.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, common.load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole each time; sources share all words 5 : 2 : 1, three epochs at most."""
    plan = mixing.plan_mix(common.cut(mixing.sizes(docs)), whole_documents=True)
    # Documents without words have no size to weigh; they stay once.
    times = F.when(F.max("size") == 0, 1).otherwise(F.round(F.max("repeats"))).cast("int").alias("__times")
    times = plan.groupBy(F.col("doc_id").alias("__id")).agg(times)
    kept = docs.join(times, docs["doc_id"].eqNullSafe(times["__id"]))
    return kept.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and its place there, without gaps."""
    narrow = common.cut(docs.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("text_bytes")).transform(sharding.shard, "doc_id", SHARDS))
    return sharding.with_slots(narrow, "doc_id").select("doc_id", "source", "text_bytes", "shard", "slot")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages hash, learn and search; SQL can't express them. Tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = common.load(spark, sf_dir, "documents")
    folder = common.new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
