"""Taint, data flow and claims as labelled closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import BROADCAST_ROWS, cut, fixpoint, reach


def propagate(sources: DataFrame, edges: DataFrame, sanitizers: DataFrame, max_hops: int, stops: DataFrame | None = None) -> DataFrame:
    """(id, label, sanitized): what each label reaches, on paths past a sanitizer and on paths without.

    sources: id, label; sanitizers: id, label. A node may be reached both ways and has then two rows. ``stops`` (id) are
    entered and not followed, unless they are sources.
    """
    san = sanitizers.select("id", "label", F.lit(True).alias("s")).distinct()
    links = cut(edges.select("src", "dst").distinct())
    blocked = stops.join(sources.select("id"), "id", "left_anti") if stops is not None else None

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(san, ["id", "label"], "left").select("id", "label", (F.col("sanitized") | F.coalesce("s", F.lit(False))).alias("sanitized"))

    # A level of the walk a round: what comes again at a later level leads nowhere new.
    seen = frontier = cut(marked(sources.select("id", "label", F.lit(False).alias("sanitized"))).distinct())
    for _ in range(max_hops):
        size = frontier.count()
        if not size:
            break
        goes = frontier if blocked is None else frontier.join(blocked, "id", "left_anti")
        goes = F.broadcast(goes) if size <= BROADCAST_ROWS else goes
        step = goes.join(links, goes["id"] == links["src"]).select(F.col("dst").alias("id"), "label", "sanitized").distinct()
        frontier = cut(marked(step).distinct().join(seen, ["id", "label", "sanitized"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def walk_verdicts(flows: DataFrame, walks: DataFrame) -> DataFrame:
    """``flows`` (flow, ...) with `verdict`: true where a walk confirms it, false where all refute it, null where none was complete.

    walks: flow, confirmed (null: unknown), complete. One incomplete walk forfeits a refutation; only refuted flows go.
    """
    g = walks.groupBy("flow").agg(F.bool_or(F.coalesce("confirmed", F.lit(False))).alias("some"), F.bool_and(F.col("complete") & F.col("confirmed").isNotNull()).alias("all_known"))
    verdict = F.when(F.col("some"), True).when(F.col("all_known"), False)
    return flows.join(g, "flow", "left").withColumn("verdict", verdict).where(F.coalesce("verdict", F.lit(True))).drop("some", "all_known")


def situations(flows: DataFrame) -> DataFrame:
    """Structural flows of one (label, source, zone, sanitized, boundary) as one row with the set of their primitives; others pass."""
    keys = ["label", "source", "zone", "sanitized", "boundary"]
    folded = flows.where("not ddg").groupBy(*keys).agg(F.sort_array(F.collect_set("primitive")).alias("primitives"))
    return folded.unionByName(flows.where("ddg").select(*keys, F.array("primitive").alias("primitives")))


def reaching_definitions(defs: DataFrame, kills: DataFrame, flow: DataFrame, uses: DataFrame) -> DataFrame:
    """(fn, var, def_block, use_block): definitions that reach a use along ``flow`` (fn, src, dst) without a kill between.

    defs: fn, block, var (one live at the block's end); kills: fn, block, var; uses: fn, block, var, read at its entry.
    """
    end = defs.select("fn", "var", F.col("block").alias("def_block"), F.col("block").alias("at"))
    f = flow.select("fn", F.col("src").alias("at"), "dst").distinct()
    k = kills.select("fn", "var", F.col("block").alias("at")).distinct()

    def entries(rows: DataFrame) -> DataFrame:
        return rows.join(f, ["fn", "at"]).select("fn", "var", "def_block", F.col("dst").alias("at"))

    def step(fresh: DataFrame) -> DataFrame:
        return entries(fresh.join(k, ["fn", "var", "at"], "left_anti"))  # a block that redefines the variable lets nothing through

    inside = fixpoint(entries(end), step)
    return inside.join(uses.select("fn", "var", F.col("block").alias("at")).distinct(), ["fn", "var", "at"]).select("fn", "var", "def_block", F.col("at").alias("use_block"))


def verify_claims(claims: DataFrame, boundary_hits: DataFrame, flow_hits: DataFrame, attempted: DataFrame) -> DataFrame:
    """(claim, verdict): violated where something hits, not_attempted where nothing was looked at, else verified.

    claims: claim, boundary, source_label, zone; boundary_hits: boundary; flow_hits: label, zone; attempted: claim.
    """
    b = boundary_hits.select("boundary").distinct().withColumn("b", F.lit(True))
    f = flow_hits.select(F.col("label").alias("source_label"), "zone").distinct().withColumn("f", F.lit(True))
    a = attempted.select("claim").distinct().withColumn("a", F.lit(True))
    j = claims.join(b, "boundary", "left").join(f, ["source_label", "zone"], "left").join(a, "claim", "left")
    return j.select("claim", F.when(F.col("a").isNull(), "not_attempted").when(F.col("b") | F.col("f"), "violated").otherwise("verified").alias("verdict"))


def magnets(nodes: DataFrame, edges: DataFrame, min_confidence: float) -> DataFrame:
    """``edges`` with dst rewritten to an unresolved name where a call without receiver lands on a method of another language."""
    s = nodes.select(F.col("id").alias("src"), F.col("language").alias("sl"))
    t = nodes.select(F.col("id").alias("dst"), F.col("language").alias("tl"), F.col("kind").alias("tk"), F.col("name").alias("tn"))
    j = edges.join(s, "src", "left").join(t, "dst", "left")
    blind = (F.col("tk").isin("method", "function")) & (F.col("sl") != F.col("tl")) & (F.col("confidence") < min_confidence)
    hit = F.coalesce(blind, F.lit(False))
    return j.select("src", F.when(hit, F.concat_ws(":", F.col("sl"), F.lit("external"), F.lit("0-0"), F.col("tn"), F.lit("unresolved"))).otherwise(F.col("dst")).alias("dst"), "type", hit.alias("demoted"))


def ready(items: DataFrame, before: DataFrame) -> DataFrame:
    """Open items whose predecessors are all resolved. items: id, resolved; before: id, waits_for."""
    pending = before.join(items.where("not resolved").select(F.col("id").alias("waits_for")), "waits_for", "left_semi").select("id").distinct()
    return items.where("not resolved").join(pending, "id", "left_anti").select("id")


__all__ = ["magnets", "propagate", "reach", "reaching_definitions", "ready", "situations", "verify_claims"]
