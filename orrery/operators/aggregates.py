"""Graph metrics, histograms, folds and guards. Each pre-aggregates on the map side and shuffles small groups only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics_by_language(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(language, nodes, edges, files): edges count for the language of their source, files are distinct paths."""
    n = nodes.groupBy("language").agg(F.count("*").alias("nodes"), F.countDistinct("path").alias("files"))
    # Degrees first: the join then moves a row per source, not per edge.
    degree = edges.groupBy(F.col("src").alias("id")).count()
    e = degree.join(nodes.select("id", "language"), "id", "left").groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.sum("count").alias("edges"))
    return n.join(e, "language", "full_outer").select("language", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("nodes", "edges", "files")])


def metrics_by_tier(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tier, nodes, edges, edges_incident): an edge is incident to the distinct tiers of its ends, unknown ends skipped."""
    tier = nodes.select("id", "tier")
    ends = edges.select("src", "dst").join(tier.toDF("src", "src_tier"), "src", "left").join(tier.toDF("dst", "dst_tier"), "dst", "left")
    pairs = ends.groupBy("src_tier", "dst_tier").agg(F.count("*").alias("n"))
    out = pairs.groupBy(F.col("src_tier").alias("tier")).agg(F.sum("n").alias("edges"))
    incident = pairs.select(F.explode(F.array_distinct(F.array("src_tier", "dst_tier"))).alias("tier"), "n").where("tier is not null").groupBy("tier").agg(F.sum("n").alias("edges_incident"))
    n = nodes.groupBy("tier").agg(F.count("*").alias("nodes"))
    joined = n.join(out, "tier", "left").join(incident, "tier", "left")
    return joined.select("tier", "nodes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("edges", "edges_incident")])


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes, total_edges, total_files, avg_confidence, median_confidence (the lower median)."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.countDistinct(F.when(F.col("path") != "<external>", F.col("path"))).alias("total_files"))
    e = edges.agg(F.count("*").alias("total_edges"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.expr("round(percentile_disc(0.5) within group (order by confidence), 3)").alias("median_confidence"))
    return n.crossJoin(e)  # one row each


def histogram(edges: DataFrame, value: str = "confidence") -> DataFrame:
    """(bin, n): two decimals."""
    return edges.groupBy(F.format_string("%.2f", F.col(value)).alias("bin")).agg(F.count("*").alias("n"))


def fold(records: DataFrame, varying: str, collected: str) -> DataFrame:
    """Rows that are equal but for ``varying`` as one row, with its sorted values; nothing is lost.

    Largest group first when ordered by the column `size`.
    """
    rest = [c for c in records.columns if c != varying]
    return records.groupBy(*rest).agg(F.sort_array(F.collect_list(varying)).alias(collected)).withColumn("size", F.size(collected))


def capped_lists(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, first, total): the ``most`` smallest values of each key in order, and how many there are.

    Ranks are limited before the exchange and lists hold ``most`` values, so that a key with very many is never gathered.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    some = rows.select(key, value).withColumn("rank", rank).where(F.col("rank") <= most)
    lists = some.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("first"))
    return lists.join(rows.groupBy(key).agg(F.count(value).alias("total")), key)


def constant_groups(edges: DataFrame, emitter: str, threshold: int, excused: Column) -> DataFrame:
    """(emitter, value, n) where one emitter gives one confidence to more than ``threshold`` edges, not all of them excused."""
    g = edges.groupBy(emitter, F.round("confidence", 9).alias("value")).agg(F.count("*").alias("n"), F.count_if(~excused).alias("unexcused"))
    return g.where((F.col("n") > threshold) & (F.col("unexcused") > 0)).select(emitter, "value", "n")


def rank_models(detections: DataFrame, edges: DataFrame, private: DataFrame) -> DataFrame:
    """(symbol_id, confidence, in_degree, rank_score): the surest detection, raised by in-degree, halved if private.

    The raise is ln(1 + d) / 20, 0.15 at most; the score stops at 1.
    """
    best = detections.groupBy("symbol_id").agg(F.max("confidence").alias("confidence"))
    degree = edges.groupBy(F.col("dst").alias("symbol_id")).agg(F.count("*").alias("in_degree"))
    hidden = private.select(F.col("id").alias("symbol_id"), F.lit(True).alias("private")).distinct()
    j = best.join(degree, "symbol_id", "left").join(hidden, "symbol_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    raised = F.least(F.lit(1.0), F.col("confidence") + F.when(F.col("in_degree") > 0, F.least(F.lit(0.15), F.log1p("in_degree") / 20)).otherwise(0.0))
    return j.select("symbol_id", "confidence", "in_degree", F.round(raised * F.when(F.col("private"), 0.5).otherwise(1.0), 6).alias("rank_score"))


def clone_clusters(nodes: DataFrame, floor: int = 2) -> DataFrame:
    """(language, shape, members, burden) of nodes of one shape: ``floor`` members at least, largest burden first."""
    g = nodes.groupBy("language", "shape").agg(F.count("*").alias("members"), F.sum("loc").alias("loc"), F.count_if(~F.col("is_test")).alias("production"))
    return g.where((F.col("members") >= floor) & (F.col("production") >= floor)).select("language", "shape", "members", (F.col("members") * F.col("loc")).cast("long").alias("burden"))


def violations(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """(class, severity, observed, allowed, breach): counts against a baseline; what the baseline lacks is allowed nothing."""
    seen = rows.groupBy("class", "severity").agg(F.count("*").alias("observed"))
    j = seen.join(baseline, ["class", "severity"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(0)).cast("long"))
    return j.withColumn("breach", F.col("observed") > F.col("allowed"))


def language_quotas(nodes: DataFrame, most: int, least: int = 1) -> DataFrame:
    """(language, n, quota): the integer share of ``most`` by count, ``least`` at least; what is left goes one each to the largest."""
    g = nodes.groupBy("language").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row per language
    share = F.greatest(F.lit(least), F.floor(F.lit(most) * (F.col("n") / F.sum("n").over(every)))).cast("long")
    g = g.withColumn("share", share).withColumn("left", F.lit(most) - F.sum("share").over(every))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "language"))
    return g.select("language", "n", (F.col("share") + F.when(place <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def dominant_language(nodes: DataFrame) -> DataFrame:
    """(path, language): a file takes the language of its first symbol."""
    return nodes.groupBy("path").agg(F.min_by("language", F.struct("line", "id")).alias("language"))
