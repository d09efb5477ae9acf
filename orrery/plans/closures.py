"""Queries of reachability: slices, dependents, dead code, coverage, components, ancestors."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import closure, filters, joins
from orrery.sources.tables import PAIRS, coded_edges, coded_nodes, decoded, edges, links, load, nodes

from .register import query, with_

NE, E, N = with_("nodes", "edges"), with_("edges"), with_("nodes")


def _walk(start: str, hops: int, links: str = "SELECT DISTINCT src, dst FROM edges", go: str = "true") -> str:
    return f", links AS ({links}), w(id, depth) AS ({start} UNION SELECT dst, depth + 1 FROM w JOIN links ON src = w.id WHERE depth < {hops} AND {go}), r AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) "


@query("forward_slice", "G3", "G4", "L8", sql=NE + _walk("SELECT 'nation:3', 0", 3, go="NOT (depth >= 1 AND w.id IN (SELECT src FROM links GROUP BY src HAVING count(*) > 50))") + "SELECT r.id, depth, tier FROM r LEFT JOIN nodes n ON n.id = r.id")
def forward_slice(spark, d):
    n = coded_nodes(spark, d)
    return closure.slice_graph(n.where("label = 'nation:3'"), n, links(spark, d), 3, hub_threshold=50, ready=True).select(decoded("id").alias("id"), "depth", "tier")


@query("tier_slice", "G3", "G20", sql=NE + _walk("SELECT 'region:1', 0", 4, "SELECT DISTINCT src, dst FROM edges JOIN nodes n ON n.id = dst WHERE tier <= 2 AND n.path NOT LIKE 'tests/%' AND confidence >= 0.95") + "SELECT r.id, depth, tier FROM r JOIN nodes n ON n.id = r.id")
def tier_slice(spark, d):
    n = nodes(spark, d)
    return closure.slice_graph(n.where("id = 'region:1'"), n, edges(spark, d), 4, max_tier=2, drop=filters.is_test_path(F.col("path")), min_confidence=0.95)


_CHANGED = "path = 'supplier/6/supplier_3.py' OR path LIKE 'brand_7/small%' OR path LIKE 'orders/F/1%'"
_DIFFERING = "path = 'supplier/6/supplier_3.py' OR path LIKE '%/supplier_4.py' OR path LIKE 'orders/O/2%'"
_BACK = "SELECT DISTINCT dst AS src, src AS dst FROM edges"


@query("dependent_files", "G1", sql=NE + _walk(f"SELECT id, 0 FROM nodes WHERE {_CHANGED}", 9, _BACK) + "SELECT DISTINCT path FROM r JOIN nodes n ON n.id = r.id")
def dependent_files(spark, d):
    n = coded_nodes(spark, d)
    return closure.dependent_files(n, links(spark, d), n.where(_CHANGED), ready=True)


@query("extra_seed_files", "U5", sql=NE + _walk(f"SELECT id, 0 FROM nodes WHERE {_CHANGED}", 9, _BACK) + f"""
, a(id, depth) AS (SELECT id, 0 FROM nodes WHERE {_CHANGED} OR {_DIFFERING} UNION SELECT dst, depth + 1 FROM a JOIN links ON src = a.id WHERE depth < 9)
SELECT DISTINCT 'seed' AS kind, path FROM nodes WHERE ({_DIFFERING}) AND NOT ({_CHANGED})
UNION ALL SELECT DISTINCT 'test', path FROM nodes WHERE path LIKE 'tests/%' AND id IN (SELECT id FROM a) AND path NOT IN (SELECT path FROM nodes JOIN r USING (id))""")
def extra_seed_files(spark, d):
    n = coded_nodes(spark, d)
    files = lambda which: n.where(which).select("path").distinct()
    return closure.extra_seeds(n, links(spark, d), files(_CHANGED), files(_DIFFERING), filters.is_test_path(F.col("path")), ready=True)


@query("import_dependents", "G2", sql=NE + _walk("SELECT id, 0 FROM nodes WHERE id IN ('order:5', 'customer:7')", 50, "SELECT DISTINCT dst AS src, src AS dst FROM edges") + "SELECT id, depth FROM r")
def import_dependents(spark, d):
    found = closure.reach(coded_nodes(spark, d).where("label in ('order:5', 'customer:7')"), closure.reverse(links(spark, d)), 50, ready=True)
    return found.select(decoded("id").alias("id"), "depth")


@query("dead_code", "G6", sql=NE + _walk("SELECT id, 0 FROM nodes WHERE id LIKE 'customer:%' AND language = 'building'", 5, "SELECT DISTINCT src, dst FROM edges WHERE type IN ('calls', 'references')") + "SELECT kind, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM r) GROUP BY kind")
def dead_code(spark, d):
    n = nodes(spark, d)
    roots = n.where("id like 'customer:%' and language = 'building'")
    return closure.unreachable(n, roots, edges(spark, d, "calls", "references"), 5).groupBy("kind").agg(F.count("*").alias("n"))


@query("transitive_coverage", "G7", sql=NE + _walk("SELECT id, 0 FROM nodes WHERE id LIKE 'customer:%' AND path LIKE 'customer/3/%'", 4, "SELECT DISTINCT src, dst FROM edges WHERE type IN ('calls', 'dispatches_to', 'references')") + "SELECT n.language, count(*) AS covered FROM r JOIN nodes n ON n.id = r.id WHERE depth > 0 GROUP BY 1")
def transitive_coverage(spark, d):
    n = coded_nodes(spark, d)
    found = closure.reach(n.where("label like 'customer:%' and path like 'customer/3/%'"), links(spark, d, "calls", "dispatches_to", "references"), 4, ready=True).where("depth > 0")
    return found.join(n.select("id", "language"), "id").groupBy("language").agg(F.count("*").alias("covered"))


@query("handler_slices", "G20", sql=NE + """
, links AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('contains', 'calls')), w(root, id, depth) AS (SELECT id, id, 0 FROM nodes WHERE id LIKE 'nation:%' UNION SELECT root, dst, depth + 1 FROM w JOIN links ON src = w.id WHERE depth < 2)
SELECT root, count(DISTINCT id) AS size, max(depth)::INT AS deepest FROM w GROUP BY root""")
def handler_slices(spark, d):
    seeds = nodes(spark, d).where("id like 'nation:%'").select("id", F.col("id").alias("root"))
    return closure.reach(seeds, edges(spark, d, "contains", "calls"), 2, key=("id", "root")).groupBy("root").agg(F.count("*").alias("size"), F.max("depth").alias("deepest"))


#: Least labels spread along the edges; ids go as their places in order, and a node's label is replaced, so that rows stay as many as nodes.
_LEAST = E + """
, ends AS (SELECT DISTINCT src AS a, dst AS b FROM edges), ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM ends UNION SELECT b FROM ends)),
n AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM ends JOIN ids x ON x.id = a JOIN ids y ON y.id = b), both_ AS MATERIALIZED (FROM n UNION SELECT b, a FROM n),
w(id, c) USING KEY (id) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT b, min(w.c) FROM w JOIN both_ ON a = w.id JOIN recurring.w AS k ON k.id = b WHERE w.c < k.c GROUP BY b),
parts AS (SELECT x.id, y.id AS component FROM w JOIN ids x ON x.k = w.id JOIN ids y ON y.k = w.c)
"""


def _whole_graph(spark, d):
    e = edges(spark, d, PAIRS).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return closure.components(e, text=decoded if dict(e.dtypes)["a"] == "bigint" else lambda c: c)


@query("connected_components", "G10", sql=_LEAST + "SELECT id, component FROM parts")
def connected_components(spark, d):
    return _whole_graph(spark, d)


@query("component_sizes", "G10", sql=_LEAST + "SELECT component, count(*) AS size FROM parts GROUP BY 1")
def component_sizes(spark, d):
    return _whole_graph(spark, d).groupBy("component").agg(F.count("*").alias("size"))


@query("owner_ancestors", "J17", "J18", sql="""
WITH RECURSIVE b AS (SELECT p_partkey AS child, p_partkey // 3 AS base FROM part WHERE p_partkey > 0), w(root, id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size = 7 UNION SELECT root, base, depth + 1 FROM w JOIN b ON child = id WHERE depth < 10)
SELECT root, list(id ORDER BY depth) AS ancestors FROM (SELECT root, id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY ALL) GROUP BY root""")
def owner_ancestors(spark, d):
    p = load(spark, d, "part")
    bases = p.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst"))
    seeds = p.where("p_size = 7").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("root"))
    found = closure.reach(seeds, bases, 10, key=("id", "root")).where("depth > 0")
    return found.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"]).alias("ancestors"))


@query("anchored_reach", "G23", "G21", sql=NE + _walk("SELECT 'region:2', 0", 3, "SELECT src, dst FROM edges WHERE type = 'contains' UNION SELECT c.id, s.id FROM nodes c JOIN nodes s ON c.kind = 'function' AND c.id LIKE 'customer:%' AND s.id LIKE 'supplier:%' AND c.line = s.line") + "SELECT id, depth FROM r")
def anchored_reach(spark, d):
    n = nodes(spark, d)
    c = n.where("kind = 'function' and id like 'customer:%'").select(F.col("id").alias("src"), F.col("line").alias("at"))
    s = n.where("id like 'supplier:%'").select(F.col("line").alias("at"), F.col("id").alias("dst"))
    return closure.reach(n.where("id = 'region:2'"), edges(spark, d, "contains"), 3, through=(c, s))


@query("boundary_slice", "G5", sql=NE + _walk("SELECT 'region:0', 0", 4, "SELECT DISTINCT src, dst FROM edges") + """
, b(id, depth) AS (SELECT id, 0 FROM nodes WHERE id LIKE 'order:%' AND line = 17 UNION SELECT src, depth + 1 FROM b JOIN links ON dst = b.id WHERE depth < 4), x AS (SELECT id FROM r WHERE id IN (SELECT id FROM b))
SELECT src, dst FROM links WHERE src IN (FROM x) AND dst IN (FROM x)""")
def boundary_slice(spark, d):
    n = coded_nodes(spark, d)
    found = closure.on_paths_to(n.where("label = 'region:0'"), n.where("label like 'order:%' and line = 17"), links(spark, d), 4, ready=True)
    return found.select(decoded("src").alias("src"), decoded("dst").alias("dst"))


def _grown(k: int) -> str:
    return f", c{k} AS (SELECT * FROM c{k - 1} UNION ALL (SELECT {k}, id FROM ranked WHERE id IN (SELECT dst FROM both_ WHERE src IN (SELECT id FROM c{k - 1})) AND id NOT IN (SELECT id FROM c{k - 1}) ORDER BY centrality DESC, id LIMIT 1))"


@query("connectivity_selection", "G8", sql=NE + """
, i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1), ranked AS (SELECT nodes.id, 2 * coalesce(i.n, 0) + coalesce(o.n, 0) AS centrality FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id)),
both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), c1 AS (SELECT 1 AS step, 'region:3' AS id)""" + "".join(map(_grown, range(2, 7))) + " SELECT step::INT AS step, id FROM c6")
def connectivity_selection(spark, d):
    from orrery.operators.ranking import centrality

    seed = 3 * 8  # region:3
    found = closure.grow(coded_nodes(spark, d), coded_edges(spark, d).select("src", "dst"), seed, 6, centrality)
    return found.select("step", decoded("id").alias("id"))


@query("slow_deselection", "F23", sql=NE + _walk("SELECT 'customer:7', 0", 3, "SELECT DISTINCT src, dst FROM edges") + "SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 AND concat('supplier:', s_suppkey) NOT IN (SELECT id FROM r)")
def slow_deselection(spark, d):
    found = closure.reach(coded_nodes(spark, d).where("label = 'customer:7'"), links(spark, d), 3, ready=True).select(decoded("id").alias("id"))
    slow = load(spark, d, "supplier").where("s_acctbal > 5000").withColumn("id", F.concat(F.lit("supplier:"), "s_suppkey"))
    return slow.join(found, "id", "left_anti").select("s_suppkey")


@query("framework_dispatch", "J28", "J17", sql="""
WITH RECURSIVE b AS (SELECT p_partkey AS child, p_partkey // 3 AS base FROM part WHERE p_partkey > 0), w(class, id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size < 9 UNION SELECT class, base, depth + 1 FROM w JOIN b ON child = id),
c AS (SELECT DISTINCT class, id AS base FROM w WHERE depth > 0), rules AS (SELECT unnest(['operators', 'operators', 'hooks']) AS framework, unnest([2, 2, 5]) AS base, unnest(['SMALL', 'PROMO', 'LARGE']) AS name)
SELECT DISTINCT c.class AS src, p_partkey AS dst, framework FROM c JOIN rules USING (base) JOIN part ON p_type = name AND p_partkey % 50 = c.class % 50""")
def framework_dispatch(spark, d):
    p = load(spark, d, "part").withColumn("scope", F.col("p_partkey") % 50)
    rules = spark.createDataFrame([("operators", 2, "SMALL"), ("operators", 2, "PROMO"), ("hooks", 5, "LARGE")], "framework string, base long, method_name string")
    # Down from the bases that a rule names: a class is met once for each of them, not with all its ancestors.
    derived = p.where("p_partkey > 0").select(F.floor(F.col("p_partkey") / 3).alias("src"), F.col("p_partkey").alias("dst"))
    down = closure.reach(rules.select(F.col("base").alias("id"), "base").distinct(), derived, None, key=("id", "base")).where("depth > 0")
    classes = p.where("p_size < 9").select(F.col("p_partkey").alias("class"), "scope")
    return joins.dispatch(down.select(F.col("id").alias("class"), "base"), classes, p.select("scope", F.col("p_type").alias("name"), F.col("p_partkey").alias("method")), rules)
