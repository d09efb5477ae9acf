"""Proportional selection, composite orders, budgets and coverage-first ranking.

Rankings are windows over keys that the data bounds (languages, files); a global order is written as a distributed sort with
a limit where the limit is the feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import language_quotas
from .closure import written


def centrality(nodes: DataFrame, edges: DataFrame, outward: DataFrame | None = None) -> DataFrame:
    """``nodes`` with in_degree, out_degree and centrality (in-degree weighs double); ``outward`` has the out-edges where ``edges`` lacks some."""
    outward = edges if outward is None else outward
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    o = outward.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    j = nodes.join(i, "id", "left").join(o, "id", "left").fillna(0, ["in_degree", "out_degree"])
    return j.withColumn("centrality", (2 * F.col("in_degree") + F.col("out_degree")).cast("long"))


def select_proportionally(ranked: DataFrame, most: int, least: int = 1) -> DataFrame:
    """The first of each language by (centrality, name, id), as many as its quota, then the first ``most`` of all."""
    quotas = language_quotas(ranked, most, least)
    inside = Window.partitionBy("language").orderBy(F.desc("centrality"), "name", "id")
    first = ranked.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most)
    chosen = first.join(F.broadcast(quotas.select("language", "quota")), "language").where("place <= quota")  # a row per language
    return chosen.orderBy(F.desc("centrality"), "name", "id").limit(most)


def rank_boosts(confidence: Column, in_degree: Column, out_degree: Column) -> Column:
    """Confidence raised by the logarithms of both degrees, by 0.35 and 0.25 at most."""
    return confidence + F.least(F.lit(0.35), F.log1p(in_degree) / 20) + F.least(F.lit(0.25), F.log1p(out_degree) / 40)


def density(ranked: DataFrame, lines: Column) -> DataFrame:
    """(path, density): the in-degrees of a file over its lines."""
    return ranked.groupBy("path").agg(F.round(F.sum("in_degree") / F.sum(lines), 6).alias("density"))


def coverage_first(ranked: DataFrame, files: int, per_file: int = 5, most: int = 100) -> DataFrame:
    """First the best of each of the ``files`` best files, then what weighs most, ``per_file`` of a file at most.

    Weight is centrality over tier. phase is 1 or 2; the order is (phase, weight, id).
    """
    w = ranked.withColumn("weight", F.col("centrality") / F.col("tier"))
    own = Window.partitionBy("path").orderBy(F.desc("weight"), "id")
    placed = w.withColumn("in_file", F.row_number().over(own)).where(F.col("in_file") <= per_file)
    best = placed.where("in_file = 1").orderBy(F.desc("weight"), "id").limit(files).select("path", F.lit(1).alias("chosen"))
    j = placed.join(F.broadcast(best), "path", "left")  # at most ``files`` rows
    phase = F.when((F.col("in_file") == 1) & (F.col("chosen") == 1), 1).otherwise(2)
    return j.withColumn("phase", phase).orderBy("phase", F.desc("weight"), "id").limit(most)


def running(rows: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """``rows`` with `before` and `total`: the sum of ``value`` of what comes before in its group, and of the whole group.

    Rows are sorted into ranges by group and order, so that a large group spreads over as many tasks as it needs; ranges are
    summed first, and a row adds what comes before it in its own range. The order must have no ties.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, F.col(group), *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(group, "__part").agg(F.sum(value).alias("__sum"))  # a row for each range and group in it
    own = Window.partitionBy(group)
    ahead = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__first"), F.sum("__sum").over(own).alias("total"))
    inside = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = placed.join(sums, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("before", F.col("__first") + F.col("__in")).select(*rows.columns, "before", "total")


def within_budget(rows: DataFrame, cost: str, order: list[Column], budget: int, buckets: str) -> DataFrame:
    """The prefix of the order whose costs stay within ``budget``, for each value of ``buckets``."""
    spent = running(rows, buckets, order, cost).withColumn("spent", (F.col("before") + F.col(cost)).cast("long"))
    return spent.where(F.col("spent") <= budget).drop("before", "total")


def underrepresented(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, least_share: float = 0.1) -> DataFrame:
    """(language, id): languages with much of all edge mentions that no seed's neighbour has, and their node of largest degree.

    Where nodes have a ``label`` besides their id, it decides ties and is what is given.
    An edge counts once for each language of its ends; a degree counts different neighbours.
    """
    lang = nodes.select("id", "language")
    both = edges.where("src <> dst").select("src", "dst").distinct()
    ends = edges.join(lang.toDF("src", "sl"), "src").join(lang.toDF("dst", "dl"), "dst").groupBy("sl", "dl").count()
    mentions = ends.select(F.explode(F.array_distinct(F.array("sl", "dl"))).alias("language"), "count").groupBy("language").agg(F.sum("count").alias("n"))
    mentions = mentions.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    sides = both.union(both.select("dst", "src")).toDF("id", "other")
    frontier = sides.join(seeds.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct().join(seeds, "id", "left_anti")
    reached = frontier.join(lang, "id").select("language").distinct()
    lacking = mentions.where(F.col("share") >= least_share).join(reached, "language", "left_anti").select("language")
    degree = sides.groupBy("id").agg(F.count("*").alias("degree"))
    candidates = nodes.join(lacking, "language").join(seeds, "id", "left_anti").join(degree, "id", "left").fillna(0, ["degree"])
    name = "label" if "label" in nodes.columns else "id"
    return candidates.groupBy("language").agg(F.max_by(name, F.struct("degree", name)).alias("id"))


def coverage_selection(ranked: DataFrame, share: float) -> DataFrame:
    """For each language, symbols by centrality until they hold ``share`` of its sum; the one that reaches it is in."""
    return running(ranked, "language", [F.desc("centrality"), F.col("id")], "centrality").where(F.col("before") < F.col("total") * F.lit(share))
