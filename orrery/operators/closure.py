"""Bounded reachability, components and fixpoints as loops of joins.

A round joins only the frontier with the edges and drops what earlier rounds have seen. Each round is written to the folder
in spark.checkpoint.dir (one of our own where it is unset and the master is local), so that lineage stays short and a lost executor costs one round;
only counts reach the driver. Labels (roots, taints) ride along in the key, so many sources walk in one loop.
"""

from __future__ import annotations

import random
import tempfile
import uuid
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of ids up to which a frontier is broadcast: a few MB.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where that is unset and the master is local."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orrery-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: what the optimizer knew of its columns goes as well.

    For long chains of joins of a table with itself, whose constraints would double with each round.
    """
    folder = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def reach(seeds: DataFrame, edges: DataFrame, max_hops: int | None, expands: DataFrame | None = None, key: tuple[str, ...] = ("id",), ready: bool = False, through: tuple[DataFrame, DataFrame] | None = None, hub: int | None = None) -> DataFrame:
    """``key`` columns and depth: what can be reached from ``seeds`` (``key``) along ``edges`` (src, dst), at its least depth.

    ``id`` is the node; further key columns are carried unchanged. ``expands`` (id, from_depth) names nodes that aren't
    followed from that depth on: hubs, boundaries. ``through`` (src, at), (at, dst) gives further edges, from each src to
    each dst of one value, which are walked by that value and never made. Nodes with more than ``hub`` edges are entered and,
    besides seeds, not followed; they are counted as a hop comes to them. A loop over hops; an empty frontier ends it, and
    nothing else where ``max_hops`` is None. ``ready`` edges are read by each hop as they are, and may repeat.
    """
    rest = [k for k in key if k != "id"]
    seen = frontier = cut(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    # Materialised and distinct, else every hop would derive the edges anew; ``ready`` says that this costs less than to write them.
    links = edges.select("src", "dst") if ready else edges.select("src", "dst").distinct()
    links = cut(links) if max_hops != 1 and not ready else links
    expands = cut(expands) if expands is not None else None
    into, out = [cut(x.distinct()) for x in through] if through else (None, None)

    def step(goes: DataFrame, links: DataFrame, at: str, to: str) -> DataFrame:
        return goes.join(links, goes["id"] == links[at]).select(F.col(to).alias("id"), *rest).distinct()

    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        size = frontier.count()
        if not size:
            break
        # A frontier whose size is known to be small goes to the edges, which then stay where they are.
        goes = F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier
        if expands is not None:
            goes = frontier.join(expands.where(F.col("from_depth") <= hop - 1), "id", "left_anti")
            goes = F.broadcast(goes) if size <= BROADCAST_ROWS else goes
        if hub is not None and hop > 1:
            pairs = cut(goes.join(links, goes["id"] == links["src"]).select("id", *rest, "dst").distinct())
            full = pairs.select("id", "dst").distinct().groupBy("id").count().where(F.col("count") > hub).select("id")
            found = pairs.join(full, "id", "left_anti").select(F.col("dst").alias("id"), *rest).distinct()
        else:
            found = step(goes, links, "src", "dst")
        if through:
            found = found.union(step(step(goes, into, "src", "at"), out, "at", "dst")).distinct()
        frontier = cut(found.join(seen, list(key), "left_anti").select(*key).withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def slice_graph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int, hub_threshold: int | None = None, max_tier: int | None = None, drop: Column | None = None, min_confidence: float | None = None, ready: bool = False) -> DataFrame:
    """(id, depth, tier): a slice along edges that pass the filters, through nodes of tiers up to ``max_tier``."""
    kept = nodes
    if max_tier is not None:
        kept = kept.where(F.col("tier") <= max_tier)
    if drop is not None:
        kept = kept.where(~drop)
    e = edges if min_confidence is None else edges.where(F.col("confidence") >= min_confidence)
    if max_tier is not None or drop is not None:
        e = e.join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    e = e.select("src", "dst") if ready else cut(e.select("src", "dst").distinct())
    found = reach(seeds, e, max_hops, ready=True, hub=hub_threshold)
    return found.join(kept.select("id", "tier"), "id", "left")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: Levels of a reverse file walk, that of the changed files among them.
FILE_LEVELS = 10


def dependent_files(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, key: tuple[str, ...] = ("id",), ready: bool = False) -> DataFrame:
    """``path`` and the columns of ``key`` besides id: the files of what reaches ``seeds`` (``key``), and their own."""
    found = reach(seeds, reverse(edges), FILE_LEVELS - 1, key=key, ready=ready)
    return found.join(nodes.where("path is not null").select("id", "path"), "id").select("path", *[k for k in key if k != "id"]).distinct()


def extra_seeds(nodes: DataFrame, edges: DataFrame, own: DataFrame, differing: DataFrame, is_test: Column, ready: bool = False) -> DataFrame:
    """(kind, path): differing files that are no ``own`` ones ('seed'), and test files that only those reach ('test').

    ``own`` and ``differing`` have a column path. Both walks run in one loop.
    """
    extra = differing.select("path").distinct().join(own, "path", "left_anti")
    seeds = own.select("path", F.lit(True).alias("own")).unionByName(extra.withColumn("own", F.lit(False)))
    walked = dependent_files(nodes, edges, nodes.select("id", "path").join(seeds, "path").select("id", "own"), ("id", "own"), ready)
    tests = walked.where(is_test).groupBy("path").agg(F.max("own").alias("own")).where("not own")
    return extra.select(F.lit("seed").alias("kind"), "path").unionByName(tests.select(F.lit("test").alias("kind"), "path"))


def on_paths_to(seeds: DataFrame, targets: DataFrame, edges: DataFrame, max_hops: int, ready: bool = False) -> DataFrame:
    """``edges`` (src, dst) of a slice from ``seeds`` that lie on a way to a target: both ends forward and backward reached."""
    e = edges.select("src", "dst") if ready else cut(edges.select("src", "dst").distinct())
    ahead = reach(seeds, e, max_hops, ready=True).select("id")
    back = reach(targets, reverse(e), max_hops, ready=True).select("id")
    both = cut(ahead.join(back, "id", "left_semi"))
    goes = F.broadcast(both) if both.count() <= BROADCAST_ROWS else both
    return e.join(goes.withColumnRenamed("id", "src"), "src", "left_semi").join(goes.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()


def grow(nodes: DataFrame, edges: DataFrame, seed, picks: int, centrality) -> DataFrame:
    """(step, id): from ``seed`` on, the neighbour of what is chosen with the largest centrality, one after the other; ties by label.

    nodes: id, label; ``centrality`` (nodes, in-edges, out-edges) adds a column of that name. Where no neighbour is left, the best node
    outside begins anew. Inherently sequential: ``picks`` is the feature, and a step asks for one row. A step reads the edges of
    what was chosen last and ranks its new neighbours, by their own edges; all nodes are ranked only where none is near.
    """
    order = (F.desc("centrality"), "label")

    def rank(some: DataFrame) -> DataFrame:
        goes = F.broadcast(some.select("id")) if some.count() <= BROADCAST_ROWS else some.select("id")
        touching = lambda end: edges.join(goes.withColumnRenamed("id", end), end, "left_semi")
        return cut(centrality(some, touching("dst"), touching("src")).select("id", "label", "centrality"))

    chosen, near = [seed], None
    for _ in range(picks - 1):
        met = edges.where(F.col("src") == chosen[-1]).select(F.col("dst").alias("id")).union(edges.where(F.col("dst") == chosen[-1]).select(F.col("src").alias("id"))).distinct()
        met = met if near is None else met.join(near, "id", "left_anti")
        fresh = rank(cut(nodes.select("id", "label").join(met, "id", "left_semi")))
        near = fresh if near is None else near.unionByName(fresh)
        best = near.where(~F.col("id").isin(chosen)).orderBy(*order).first() or centrality(nodes, edges, edges).where(~F.col("id").isin(chosen)).orderBy(*order).first()
        if best is None:
            break
        chosen.append(best["id"])
    return nodes.sparkSession.createDataFrame(list(enumerate(chosen, 1)), f"step int, id {dict(nodes.dtypes)['id']}")


def unreachable(nodes: DataFrame, roots: DataFrame, edges: DataFrame, max_hops: int = 50) -> DataFrame:
    """``nodes`` that no root reaches."""
    return nodes.join(reach(roots, edges, max_hops).select("id"), "id", "left_anti")


#: Edges that a task turns into a forest at once.
FOREST = 1 << 21


def components(edges: DataFrame, most_rounds: int = 60, text=lambda c: c) -> DataFrame:
    """(id, component) of the ends of ``edges`` (a, b) of any type: component is the smallest id of its part, both as ``text`` writes them.

    Tasks first turn what they read into forests, which move fewer edges. Then contraction: in each round every node points at
    its neighbour of the least rank, ranks being hashes that change from round to round, and once more at where that one points;
    edges are renamed and loops dropped. So the nodes left fall by a constant factor, whatever the part's diameter. Each round
    keeps the pointers of the nodes that it still had, which are followed from the last round to the first.

    Ids go as 64-bit hashes, with a seed under which all differ; ranks are these with bits flipped, so that both are numbers.
    Edges may repeat; they are read twice.
    """

    def forest(frames):
        # Of each FOREST of a task's edges, every node but the least of its part to that.

        def stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
            ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            x, y, least = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
            while True:
                p, q = least[x], least[y]
                if not (differ := p != q).any():
                    break
                np.minimum.at(least, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
                while (up := least[least]).tobytes() != least.tobytes():
                    least = up
            own = np.flatnonzero(least != np.arange(len(ids)))
            return pd.DataFrame({"a": ids[own], "b": ids[least[own]]})

        held, size = [], 0
        for pdf in frames:
            held.append((pdf["a"].to_numpy(), pdf["b"].to_numpy()))
            size += len(pdf)
            if size >= FOREST:
                yield stars(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))

    pairs = edges.where("a <> b").select("a", "b")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    for seed in range(9):
        names = written(ids.select("id", F.xxhash64("id", F.lit(seed)).alias("v")))
        if names.count() == names.select("v").distinct().count():
            break
        ids = names.select("id")
    else:
        raise RuntimeError("ids collide")
    hashed = pairs.select(F.xxhash64("a", F.lit(seed)).alias("a"), F.xxhash64("b", F.lit(seed)).alias("b"))
    e = written(hashed.mapInPandas(forest, "a long, b long"))
    bits, rounds = random.Random(5), []
    for _ in range(most_rounds):
        if e.isEmpty():
            break
        flip = F.lit(bits.getrandbits(64) - (1 << 63))
        rank = lambda c: F.col(c).bitwiseXOR(flip)  # noqa: E731, B023
        both = e.union(e.select("b", "a")).toDF("v", "w").groupBy("v").agg(F.min(rank("w")).alias("m"))
        near = written(both.select("v", F.least("m", rank("v")).bitwiseXOR(flip).alias("p")))
        parent = written(near.join(near.toDF("p", "up"), "p").select("v", F.col("up").alias("p")))
        rounds.append(parent)
        e = e.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b").where("pa <> pb")
        e = written(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not rounds:
        return edges.select(text(F.col("a")).alias("id"), text(F.col("a")).alias("component")).where(F.lit(False))
    members = rounds.pop().toDF("v", "root")
    while rounds:
        members = rounds.pop().join(members.toDF("p", "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
    members = written(names.join(members, "v").select(text(F.col("id")).alias("id"), "root"))
    least = members.groupBy("root").agg(F.min("id").alias("component"))
    return members.join(least, "root").select("id", "component")


def fixpoint(seeds: DataFrame, step, most_rounds: int = 100) -> DataFrame:
    """All rows that ``step`` (new rows -> rows) derives from ``seeds``, until nothing new comes."""
    seen = fresh = cut(seeds.distinct())
    for _ in range(most_rounds):
        if fresh.isEmpty():
            return seen
        fresh = cut(step(fresh).distinct().join(seen, seen.columns, "left_anti").select(*seen.columns))
        seen = seen.unionByName(fresh)
    raise RuntimeError("no fixpoint")
