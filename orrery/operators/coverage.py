"""Which test covers which line: exclusive lines, costs, similarity, greedy covers and differences of sets.

covers: test, line rows, distinct. Bit sets of single machines are rows here, so no task holds a test's or line's whole set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .closure import cut


def exclusive_lines(covers: DataFrame) -> DataFrame:
    """(test, n): lines that no other test covers; tests without one have 0."""
    sole = covers.groupBy("line").agg(F.min("test").alias("test"), F.count("*").alias("k")).where("k = 1").groupBy("test").agg(F.count("*").alias("n"))
    return covers.select("test").distinct().join(sole, "test", "left").select("test", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cost_model(costs: DataFrame) -> DataFrame:
    """(test, grp, marginal, fixed): a group's median setup recurs for each test, what its largest is above it is paid once.

    costs: test, grp, setup, call, teardown.
    """
    g = costs.groupBy("grp").agg(F.expr("percentile(setup, 0.5)").alias("median"), F.max("setup").alias("most"))
    j = costs.join(g, "grp")
    return j.select("test", "grp", F.round(F.col("call") + F.col("teardown") + F.col("median"), 6).alias("marginal"), F.round(F.greatest(F.lit(0.0), F.col("most") - F.col("median")), 6).alias("fixed"))


def greedy_cover(covers: DataFrame, costs: DataFrame, picks: int) -> DataFrame:
    """(step, test, new_lines): the tests that add most lines for their cost, one after the other; ``picks`` is the feature.

    costs: test, cost. A step is one aggregate over the lines that are left; ties go to the smaller test. Inherently
    sequential: only the chosen test's id reaches the driver.
    """
    spark = covers.sparkSession
    left, chosen = cut(covers.select("test", "line").distinct()), []
    for step in range(1, picks + 1):
        gain = left.groupBy("test").agg(F.count("*").alias("n")).join(costs, "test").orderBy((F.col("n") / F.greatest(F.col("cost"), F.lit(1e-9))).desc(), "test").first()
        if gain is None:
            break
        chosen.append((step, gain["test"], gain["n"]))
        left = cut(left.join(left.where(F.col("test") == gain["test"]).select("line"), "line", "left_anti").select("test", "line"))
    kind = dict(covers.dtypes)["test"]
    return spark.createDataFrame(chosen, f"step int, test {kind}, new_lines long")


def redundancy(covers: DataFrame, known: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: measurable, unmeasured, chosen and redundant tests. known, chosen: test."""
    measured = covers.select("test").distinct().withColumn("m", F.lit(1))
    j = measured.join(known.select("test").distinct().withColumn("k", F.lit(1)), "test", "full_outer").join(chosen.select("test").distinct().withColumn("c", F.lit(1)), "test", "full_outer")
    m, c = F.col("m").isNotNull(), F.col("c").isNotNull()
    return j.agg(F.count_if(m).alias("measurable"), F.count_if(~m & F.col("k").isNotNull()).alias("unmeasured"), F.count_if(c).alias("chosen"), F.count_if(m & ~c).alias("redundant"))


def residual(covers: DataFrame, chosen: DataFrame) -> DataFrame:
    """Lines that some test covers and no chosen one."""
    return covers.select("line").distinct().join(covers.join(chosen, "test", "left_semi").select("line").distinct(), "line", "left_anti")


def jaccard(covers: DataFrame, group: str) -> DataFrame:
    """(a, b, similarity) of the tests of one group that share lines: sizes and shared lines are counts."""
    size = covers.groupBy("test").agg(F.count("*").alias("n"))
    x, y = covers.select(group, "line", F.col("test").alias("a")), covers.select(group, "line", F.col("test").alias("b"))
    shared = x.join(y, [group, "line"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    j = shared.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return j.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("similarity"))


def at_risk(covers: DataFrame, cut_tests: DataFrame, block) -> DataFrame:
    """(block, statements): lines only tests that are cut cover, by block."""
    rest = covers.join(cut_tests, "test", "left_anti").select("line").distinct()
    lost = covers.join(cut_tests, "test", "left_semi").select("line").distinct().join(rest, "line", "left_anti")
    return lost.groupBy(block.alias("block")).agg(F.count("*").alias("statements"))


def statement_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(block, change): new, gone, whole (digest and prose differ), prose (only prose) or same. old, new: block, digest, prose."""
    j = old.toDF("block", "d1", "p1").join(new.toDF("block", "d2", "p2"), "block", "full_outer")
    change = F.when(F.col("d1").isNull(), "new").when(F.col("d2").isNull(), "gone").when(F.col("d1") != F.col("d2"), "whole").when(F.col("p1") != F.col("p2"), "prose").otherwise("same")
    return j.select("block", change.alias("change"))


def first_mention(added: DataFrame, texts: DataFrame, word) -> DataFrame:
    """(name, path): for each added name the first text, by path, with the name as a whole word."""
    words = texts.select("path", F.explode(F.array_distinct(word)).alias("name"))
    return added.join(words, "name", "left").groupBy("name").agg(F.min("path").alias("path"))


def gapless(rows: DataFrame, order: str, out: str, buckets: int = 64) -> DataFrame:
    """``rows`` with numbers from 0 in order of ``order``, without gaps and without one task that sees all rows.

    Range partitions are numbered inside and moved up by the counts before them.
    """
    ranged = cut(rows.repartitionByRange(buckets, order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return ranged.withColumn("__n", inside).join(F.broadcast(first), "__p").withColumn(out, (F.col("__first") + F.col("__n")).cast("long")).drop("__p", "__n", "__first")  # a row per bucket


def graph_verdict(selections: DataFrame, max_extra_tests: int) -> DataFrame:
    """``selections`` (..., need_analysis, extra_tests) with `verdict`: added_file where an added file needs analysis, too_far_behind beyond the limit, else use."""
    verdict = F.when(F.col("need_analysis") > 0, "added_file").when(F.col("extra_tests") > max_extra_tests, "too_far_behind").otherwise("use")
    return selections.withColumn("verdict", verdict)
