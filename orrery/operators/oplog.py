"""Folding an append-only operation log into items.

An operation has item, op, clock, nonce and payload. Every field is a register whose last writer by (clock, nonce) wins, so
the result doesn't depend on the order of arrival; wall time never breaks ties. Each fold is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last(value: Column, when: Column) -> Column:
    """The value of the last operation for which ``when`` holds."""
    return F.max_by(value, F.when(when, F.struct("clock", "nonce")))


def fold(ops: DataFrame) -> DataFrame:
    """(item, created, priority, status, locked, discussions): the state of every item with a create operation.

    The create of the lowest (clock, nonce) is the base; further ones count for nothing but their fields.
    """
    op = F.col("op")
    g = ops.groupBy("item").agg(
        F.min_by("ts", F.when(op == "create", F.struct("clock", "nonce"))).alias("created"),
        last(F.col("priority"), op.isin("create", "update")).alias("priority"),
        last(F.col("status"), op.isin("create", "update", "resolve", "lock")).alias("status"),
        last(op == "lock", op.isin("lock", "resolve")).alias("locked"),
        F.count_if(op == "discuss").alias("discussions"),
    )
    return g.where("created is not null").withColumn("locked", F.coalesce("locked", F.lit(False)))


def fold_sets(ops: DataFrame, element: str, adds: Column, removes: Column) -> DataFrame:
    """(item, members): elements whose last operation added them, sorted."""
    each = ops.where(adds | removes).groupBy("item", element).agg(F.max_by(adds, F.struct("clock", "nonce")).alias("there"))
    return each.where("there").groupBy("item").agg(F.sort_array(F.collect_list(element)).alias("members"))


def thread(ops: DataFrame, clears: Column) -> DataFrame:
    """Discussion entries after the last clearing operation of their item."""
    order = F.struct("clock", "nonce")
    cleared = ops.where(clears).groupBy("item").agg(F.max(order).alias("cleared"))
    j = ops.where("op = 'discuss'").join(cleared, "item", "left")
    return j.where(F.col("cleared").isNull() | (order > F.col("cleared"))).drop("cleared")


def union_blocks(*logs: DataFrame) -> DataFrame:
    """All operations of several copies of a log once each, with the first source and place in it."""
    out = None
    for k, log in enumerate(logs):
        part = log.withColumn("source", F.lit(k))
        out = part if out is None else out.unionByName(part)
    key = [c for c in out.columns if c not in ("source", "pos")]
    return out.groupBy(*key).agg(F.min(F.struct("source", "pos")).alias("x")).select(*key, "x.source", "x.pos")


def timeline(ops: DataFrame) -> DataFrame:
    """(item, day, priority): the state at the end of each day on which it differs from the day before; null while not open.

    Within a day the state is that of all operations so far: the running last writers by (clock, nonce) over days.
    """
    order = F.struct("clock", "nonce")
    daily = ops.withColumn("day", F.to_date("ts")).groupBy("item", "day").agg(
        F.max(F.when(F.col("op").isin("create", "update"), F.struct(order.alias("o"), "priority"))).alias("p"),
        F.max(F.when(F.col("op").isin("create", "update", "resolve", "lock"), F.struct(order.alias("o"), "status"))).alias("s"),
        F.min(F.when(F.col("op") == "create", order)).alias("c"),
    )
    run = Window.partitionBy("item").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = daily.select("item", "day", F.max("p").over(run).alias("p"), F.max("s").over(run).alias("s"), F.min("c").over(run).alias("c"))
    now = F.when(F.col("c").isNotNull() & (F.col("s.status") != "done"), F.col("p.priority"))
    before = F.lag("priority").over(Window.partitionBy("item").orderBy("day"))
    return state.select("item", "day", now.alias("priority")).withColumn("before", before).where(~F.col("priority").eqNullSafe(F.col("before"))).select("item", "day", "priority")


def trend(changes: DataFrame) -> DataFrame:
    """(day, open, mean_priority) for every calendar day between the first and last change, from running differences.

    Each change adds to or takes from its day's number and sum of open items; only days, not items, are windowed globally.
    """
    before = F.lag("priority").over(Window.partitionBy("item").orderBy("day"))
    delta = changes.withColumn("before", before).groupBy("day").agg(
        F.sum(F.col("priority").isNotNull().cast("int") - F.col("before").isNotNull().cast("int")).alias("n"),
        F.sum(F.coalesce("priority", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("total"),
    )
    days = delta.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = days.join(delta, "day", "left").fillna(0, ["n", "total"])
    out = j.select("day", F.sum("n").over(run).cast("long").alias("open"), F.sum("total").over(run).alias("total"))
    return out.select("day", "open", F.when(F.col("open") > 0, F.round(F.col("total") / F.col("open"), 4)).alias("mean_priority"))


def evidence(rows: DataFrame, least: int = 30) -> DataFrame:
    """One row: observations, informative, commits, dangerous, unjudgeable, verdict.

    Only trustworthy rows count; any dangerous miss disqualifies; fewer than ``least`` commits are insufficient; rows
    without data on misses are unjudgeable. rows: trustworthy, sha, misses (null if unknown).
    """
    t = F.coalesce(F.col("trustworthy"), F.lit(False))
    g = rows.agg(
        F.count("*").alias("observations"), F.count_if(t).alias("informative"), F.countDistinct(F.when(t, F.col("sha"))).alias("commits"),
        F.coalesce(F.sum(F.when(t, F.col("misses"))), F.lit(0)).alias("dangerous"), F.count_if(t & F.col("misses").isNull()).alias("unjudgeable"),
    )
    return g.withColumn("verdict", F.when(F.col("dangerous") > 0, "disqualified").when(F.col("commits") < least, "insufficient").otherwise("met"))


def retained(graphs: DataFrame, per_build: int = 2, builds: int = 4) -> DataFrame:
    """Of stored graphs (id, build), the newest ``per_build`` of the ``builds`` builds with the newest graphs."""
    newest = graphs.groupBy("build").agg(F.max("id").alias("newest")).orderBy(F.desc("newest")).limit(builds).select("build")
    n = F.row_number().over(Window.partitionBy("build").orderBy(F.desc("id")))
    return graphs.join(F.broadcast(newest), "build").withColumn("n", n).where(F.col("n") <= per_build).select(*graphs.columns)  # at most ``builds`` rows
