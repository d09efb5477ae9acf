"""Queries of taint, data flow, claims and blocking order."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import closure, flow
from orrery.sources.tables import edges, load, nodes

from .register import query, with_

NE, E = with_("nodes", "edges"), with_("edges")


@query("taint_propagation", "G15", sql=NE + """
, links AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('contains', 'calls', 'dispatches_to')), san AS (SELECT id, 'secret' AS label FROM nodes WHERE id LIKE 'customer:%' AND line % 2 = 0), st AS (SELECT id FROM nodes WHERE kind = 'method' AND line % 3 = 0),
w(id, label, sanitized, depth) AS (SELECT id, label, false, 0 FROM (SELECT id, unnest(['secret', 'input']) AS label FROM nodes WHERE id LIKE 'nation:%' AND line < 4)
  UNION SELECT dst, w.label, w.sanitized OR EXISTS (SELECT 1 FROM san WHERE san.id = dst AND san.label = w.label), depth + 1 FROM w JOIN links ON src = w.id WHERE depth < 3 AND w.id NOT IN (SELECT id FROM st))
SELECT DISTINCT id, label, sanitized FROM w""")
def taint_propagation(spark, d):
    n = nodes(spark, d)
    sources = n.where("id like 'nation:%' and line < 4").select("id", F.explode(F.array(F.lit("secret"), F.lit("input"))).alias("label"))
    clean = n.where("id like 'customer:%' and line % 2 = 0").select("id", F.lit("secret").alias("label"))
    return flow.propagate(sources, edges(spark, d, "contains", "calls", "dispatches_to"), clean, 3, n.where("kind = 'method' and line % 3 = 0").select("id"))


@query("taint_situations", "A21", sql="""
WITH f AS (SELECT o_orderpriority AS label, concat('s', o_custkey % 20) AS source, o_orderstatus AS zone, o_orderkey % 2 = 0 AS sanitized, concat('b', o_custkey % 3) AS boundary, concat('p', o_orderkey % 9) AS primitive, o_orderkey % 50 = 0 AS ddg FROM orders)
SELECT label, source, zone, sanitized, boundary, list_sort(list(DISTINCT primitive)) AS primitives FROM f WHERE NOT ddg GROUP BY ALL UNION ALL SELECT label, source, zone, sanitized, boundary, [primitive] FROM f WHERE ddg""")
def taint_situations(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    f = load(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.concat(F.lit("s"), c % 20).alias("source"), F.col("o_orderstatus").alias("zone"), (k % 2 == 0).alias("sanitized"), F.concat(F.lit("b"), c % 3).alias("boundary"), F.concat(F.lit("p"), k % 9).alias("primitive"), (k % 50 == 0).alias("ddg"))
    return flow.situations(f)


_BLOCKS = "SELECT o_custkey AS fn, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS block, o_orderstatus AS var, o_orderpriority AS prio FROM orders"


def _blocks(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return load(spark, d, "orders").select(F.col("o_custkey").alias("fn"), n.alias("block"), F.col("o_orderstatus").alias("var"), F.col("o_orderpriority").alias("prio"))


@query("reaching_definitions", "G14", sql=f"""
WITH RECURSIVE b AS ({_BLOCKS}), flow AS (SELECT fn, block AS src, block + 1 AS dst FROM b UNION SELECT fn, block, block - 2 FROM b WHERE block % 4 = 0), w(fn, var, def_block, place) AS (
  SELECT b.fn, var, block, dst FROM b JOIN flow f ON f.fn = b.fn AND f.src = block UNION SELECT w.fn, w.var, def_block, dst FROM w JOIN flow f ON f.fn = w.fn AND f.src = w.place WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.fn = w.fn AND b.var = w.var AND b.block = w.place))
SELECT DISTINCT w.fn, w.var, def_block, place AS use_block FROM w JOIN b ON b.fn = w.fn AND b.block = w.place AND b.prio < '3' AND w.var = (CASE b.block % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END)""")
def reaching_definitions(spark, d):
    b = closure.cut(_blocks(spark, d))
    f = b.select("fn", F.col("block").alias("src"), (F.col("block") + 1).alias("dst")).union(b.where("block % 4 = 0").select("fn", "block", F.col("block") - 2))
    k = F.col("block") % 3
    uses = b.where("prio < '3'").select("fn", "block", F.when(k == 0, "F").when(k == 1, "O").otherwise("P").alias("var"))
    return flow.reaching_definitions(b, b, f, uses)


@query("parameter_returns", "G13", sql=f"""
WITH RECURSIVE b AS ({_BLOCKS}), l AS (SELECT fn, block AS src, block + 1 + block % 2 AS dst FROM b), w(fn, place) AS (SELECT fn, 1 FROM b UNION SELECT w.fn, dst FROM w JOIN l ON l.fn = w.fn AND l.src = w.place)
SELECT fn, bool_or(place IN (SELECT block FROM b WHERE b.fn = w.fn AND b.var = 'P')) AS returned FROM w GROUP BY fn""")
def parameter_returns(spark, d):
    b = closure.cut(_blocks(spark, d))
    node = lambda c: F.concat_ws(":", "fn", c)
    links = b.select(node("block").alias("src"), F.concat_ws(":", "fn", F.col("block") + 1 + F.col("block") % 2).alias("dst"))
    seeds = b.select(node(F.lit(1)).alias("id"), "fn").distinct()
    hit = b.where("var = 'P'").select(node("block").alias("id"), F.lit(True).alias("hit"))
    found = closure.reach(seeds, links, 60, key=("id", "fn")).join(hit, "id", "left")
    return found.groupBy("fn").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("returned"))


@query("claims", "G17", "A15", sql="""
SELECT n_nationkey AS claim, CASE WHEN n_nationkey % 5 = 4 THEN 'not_attempted' WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = CASE n_nationkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'NONE' END AND c_acctbal > 9000) THEN 'violated' ELSE 'verified' END AS verdict FROM nation""")
def claims(spark, d):
    k = F.col("n_nationkey")
    n = load(spark, d, "nation").select(k.alias("claim"), F.concat(F.lit("b"), k).alias("boundary"), F.when(k % 2 == 0, "BUILDING").otherwise("NONE").alias("source_label"), k.cast("string").alias("zone"))
    b = load(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("b"), "s_nationkey").alias("boundary"))
    f = load(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").cast("string").alias("zone"))
    return flow.verify_claims(n, b, f, n.where("claim % 5 <> 4"))


@query("receiver_magnets", "G18", "G24", "P14", "F13", sql=NE + """
, j AS (SELECT e.src, e.dst, e.type, s.language AS sl, t.name AS tn, coalesce(t.kind IN ('method', 'function') AND s.language <> t.language AND e.confidence < 0.96, false) AS demoted FROM edges e LEFT JOIN nodes s ON s.id = src LEFT JOIN nodes t ON t.id = dst)
SELECT type, demoted, CASE WHEN demoted THEN concat(sl, ':external:0-0:', tn, ':unresolved') ELSE dst END AS dst, count(*) AS n FROM j GROUP BY ALL""")
def receiver_magnets(spark, d):
    return flow.magnets(nodes(spark, d), edges(spark, d), 0.96).groupBy("type", "demoted", "dst").agg(F.count("*").alias("n"))


@query("ready_items", "G22", sql="SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey // 2 AND p.o_orderkey <> o.o_orderkey AND p.o_orderstatus <> 'F')")
def ready_items(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("resolved"))
    before = o.select("id", F.floor(F.col("id") / 2).alias("waits_for")).where("id <> waits_for")
    return flow.ready(o, before)


_W = "SELECT o_custkey AS flow, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN NULL ELSE o_orderkey % 5 = 0 END AS confirmed, o_orderkey % 9 > 0 AS complete FROM orders"


@query("walk_verdicts", "G16", "A13", sql=f"""
WITH w AS ({_W}), g AS (SELECT flow, bool_or(coalesce(confirmed, false)) AS sure, bool_and(complete AND confirmed IS NOT NULL) AS known FROM w GROUP BY 1), v AS (SELECT c_custkey AS flow, CASE WHEN sure THEN true WHEN known THEN false END AS verdict FROM customer LEFT JOIN g ON flow = c_custkey)
SELECT coalesce(verdict::VARCHAR, 'unrecorded') AS bucket, count(*) AS n FROM v WHERE coalesce(verdict, true) GROUP BY 1""")
def walk_verdicts(spark, d):
    k = F.col("o_orderkey")
    w = load(spark, d, "orders").select(F.col("o_custkey").alias("flow"), F.expr("case o_orderstatus when 'F' then false when 'O' then null else o_orderkey % 5 = 0 end").alias("confirmed"), (k % 9 > 0).alias("complete"))
    out = flow.walk_verdicts(load(spark, d, "customer").select(F.col("c_custkey").alias("flow")), w)
    return out.groupBy(F.coalesce(F.col("verdict").cast("string"), F.lit("unrecorded")).alias("bucket")).agg(F.count("*").alias("n"))


@query("definitions_and_uses", "E5", sql="""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [lower(p_type), 'b'] ELSE [] END AS defines, CASE WHEN p_size % 2 = 0 THEN ['f', 'c'] ELSE ['print', lower(p_type)] END AS uses FROM part""")
def definitions_and_uses(spark, d):
    from orrery.functions.text import definitions_and_uses as extract

    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lower("p_type"), F.lit(", b = f(c) + c"))).otherwise(F.concat(F.lit("print("), F.lower("p_type"), F.lit(")")))
    return load(spark, d, "part").select("p_partkey", extract(line).alias("x")).select("p_partkey", "x.*")
