"""Survey documents: a JSON object with lists of nodes and edges, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, name string, kind string, path string, language string, supply_chain_tier int, span struct<start_line:int,end_line:int,start_col:int,end_col:int>, meta map<string,string>"
EDGE = "id string, src string, dst string, type string, line int, confidence double, meta map<string,string>"
SCHEMA = f"schema_version string, view string, nodes array<struct<{', '.join(f'{n}:{t}' for n, t in (f.strip().split(' ', 1) for f in ('id string', 'name string', 'kind string', 'path string', 'language string', 'supply_chain_tier int')))}>>, edges array<struct<id:string,src:string,dst:string,type:string,line:int,confidence:double>>"
VERSION = "1"
#: Names under which a survey is looked for, plain before gzipped.
SURVEY_NAMES = ("survey.json", "survey.json.gz", "behavior_map.json", "behavior_map.json.gz")


def with_fields(df: DataFrame, column: str, fields: str) -> DataFrame:
    """``df`` with the fields of a JSON column in place of it; text that isn't JSON gives nulls."""
    return df.withColumn("__j", F.from_json(column, fields)).select(*[c for c in df.columns if c != column], "__j.*")


def read_survey(spark: SparkSession, path: str, view: str = "behavior_map") -> DataFrame:
    """One row per document. Documents without nodes, or of another view, are errors when read."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    ok = F.col("nodes").isNotNull() & (F.coalesce("view", F.lit("behavior_map")) == view)
    return doc.withColumn("nodes", F.when(ok, F.col("nodes")).otherwise(F.raise_error(F.lit(f"not a survey of view {view}"))))


def survey_nodes(doc: DataFrame) -> DataFrame:
    return doc.select(F.inline("nodes"))


def survey_edges(doc: DataFrame) -> DataFrame:
    return doc.select(F.inline("edges"))


def write_survey(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as JSON lines, a folder each; every part is written by the task that has it."""
    nodes.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/nodes")
    edges.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/edges")


def write_document(nodes: DataFrame, edges: DataFrame, folder: str, view: str = "behavior_map") -> None:
    """One gzipped document, as the format has it: all nodes and edges are one task's row, so this is for surveys of such a size."""
    node = F.struct("id", "name", "kind", "path", "language", F.col("tier").cast("int").alias("supply_chain_tier"))
    edge = F.struct("id", "src", "dst", "type", F.col("line").cast("int").alias("line"), F.col("confidence").cast("double").alias("confidence"))
    n, e = nodes.agg(F.collect_list(node).alias("nodes")), edges.agg(F.collect_list(edge).alias("edges"))
    whole = n.join(F.broadcast(e), F.lit(True)).select(F.lit(VERSION).alias("schema_version"), F.lit(view).alias("view"), "nodes", "edges")
    whole.coalesce(1).write.option("compression", "gzip").json(f"{folder}/{SURVEY_NAMES[-1]}")


def find_survey(spark: SparkSession, folder: str) -> str | None:
    """The first of SURVEY_NAMES in a folder of any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in SURVEY_NAMES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(conf).exists(path):
            return f"{folder}/{name}"
    return None
