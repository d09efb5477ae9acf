"""Queries of the linking joins over the encoded tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import names
from orrery.operators import filters, joins
from orrery.sources.tables import code, coded_edges, coded_nodes, decoded, edges, links, load, nodes

from .register import query, with_

N, NE, E = with_("nodes"), with_("nodes", "edges"), with_("edges")


@query("span_containment", "J3", "P23", "S15", sql=N + """
, s AS (SELECT id AS container, path, line AS start, line + 40 + (line % 3) * 60 AS stop FROM nodes WHERE kind IN ('class', 'function') AND tier IN (2, 3)), p AS (SELECT id, path, line FROM nodes WHERE tier IN (2, 3))
SELECT id, arg_min(container, (stop - start, container)) AS container FROM p JOIN s USING (path) WHERE line BETWEEN start AND stop AND id <> container GROUP BY id""")
def span_containment(spark, d):
    n = nodes(spark, d).where("tier in (2, 3)")
    spans = n.where("kind in ('class', 'function')").select(F.col("id").alias("container"), "path", F.col("line").alias("start"), (F.col("line") + 40 + (F.col("line") % 3) * 60).alias("end"))
    return joins.innermost_container(n.select("id", "path", "line"), spans)


@query("route_containment", "J4", "J5", sql=N + """
, s AS (SELECT id AS container, path, line AS start, line + 99 AS stop FROM nodes WHERE tier = 4 AND line % 5 = 0), p AS (SELECT id, path, line FROM nodes WHERE tier = 4 AND line % 5 = 1)
SELECT id, arg_min(container, (stop - start, container)) AS container FROM p JOIN s USING (path) WHERE line BETWEEN start AND stop GROUP BY id""")
def route_containment(spark, d):
    n = nodes(spark, d).where((F.col("tier") == 4) & ~filters.is_test_path(F.col("path")))
    spans = n.where("line % 5 = 0").select(F.col("id").alias("container"), "path", F.col("line").alias("start"), (F.col("line") + 99).alias("end"))
    return joins.innermost_container(n.where("line % 5 = 1").select("id", "path", "line"), spans)


@query("containment_by_name", "J2", sql=N + """
, c AS (SELECT id AS container, name, path, language, count(*) OVER (PARTITION BY name) AS n FROM nodes WHERE kind = 'method' AND tier = 3), ch AS (SELECT id, name AS parent, path, language FROM nodes WHERE kind = 'function' AND tier = 3),
j AS (SELECT id, container, CASE WHEN n = 1 THEN 0 WHEN ch.path = c.path THEN 1 WHEN ch.language = c.language THEN 2 END AS rank FROM ch JOIN c ON parent = name)
SELECT id, arg_min(container, (rank, container)) AS container FROM j WHERE rank IS NOT NULL GROUP BY id""")
def containment_by_name(spark, d):
    n = nodes(spark, d).where("tier = 3")
    return joins.containment_by_name(n.where("kind = 'function'").select("id", F.col("name").alias("parent"), "path", "language"), n.where("kind = 'method'").select(F.col("id").alias("container"), "name", "path", "language"))


@query("middleware_chain", "J6", "W7", sql=N + "SELECT path, id AS src, dst FROM (SELECT *, lead(id) OVER (PARTITION BY path ORDER BY line, id) AS dst FROM nodes WHERE tier <= 3) WHERE dst IS NOT NULL")
def middleware_chain(spark, d):
    return joins.consecutive(nodes(spark, d).where("tier <= 3"), "path", "line", "id")


_CALLS = "SELECT concat('order:', o_orderkey) AS src, p_name AS name, (o_orderkey % 90)::INT AS line, 0.6 AS confidence FROM orders JOIN part ON p_partkey = o_custkey % 50"


@query("method_call_recovery", "J7", "W4", "J26", sql=NE + f"""
, calls AS ({_CALLS}), h AS (SELECT src, dst AS class, line AS hline, confidence AS hconf FROM edges WHERE type = 'dispatches_to'), m AS (SELECT dst AS class, p.name, min(src) AS method FROM edges e JOIN nodes p ON p.id = src WHERE type = 'depends_on' GROUP BY ALL),
g AS (SELECT c.src, c.name, c.line, arg_min({{'m': method, 'hc': hconf}}, (abs(c.line - hline), h.class)) AS best, count(*) AS n, min(c.confidence) AS confidence FROM calls c JOIN h USING (src) JOIN m ON m.class = h.class AND m.name = c.name GROUP BY 1, 2, 3)
SELECT src, best.m AS dst, line, (CASE WHEN n > 1 THEN least(confidence, best.hc, 0.5) ELSE least(confidence, best.hc) END)::DOUBLE AS confidence, n > 1 AS fallback FROM g WHERE (src, best.m) NOT IN (SELECT (src, dst) FROM edges WHERE type = 'references')""")
def method_call_recovery(spark, d):
    o, p = load(spark, d, "orders"), load(spark, d, "part")
    calls = o.join(p, F.col("p_partkey") == F.col("o_custkey") % 50).select(code("order", "o_orderkey").alias("src"), F.col("p_name").alias("name"), (F.col("o_orderkey") % 90).cast("int").alias("line"), F.lit(0.6).alias("confidence"))
    hints = coded_edges(spark, d, "dispatches_to").select("src", F.col("dst").alias("class"), "line", "confidence")
    # The smallest of a class's methods by its id as text; pairs may repeat for that.
    parts = coded_nodes(spark, d).select(F.col("id").alias("src"), "name", "label")
    methods = links(spark, d, "depends_on").join(parts, "src").groupBy(F.col("dst").alias("class"), "name").agg(F.min(F.struct("label", "src"))["src"].alias("method"))
    found = joins.recover_calls(calls, hints, methods, links(spark, d, "references"), decoded)
    return found.withColumns({"src": decoded("src"), "dst": decoded("dst")})


@query("receiver_dispatch", "J8", sql=NE + f"""
, calls AS (SELECT src, name FROM ({_CALLS})), m AS (SELECT name, min(id) AS dst FROM nodes WHERE tier = 3 AND kind = 'method' GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT DISTINCT src, dst FROM calls JOIN m USING (name) WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edges WHERE type = 'references')""")
def receiver_dispatch(spark, d):
    o, p = load(spark, d, "orders"), load(spark, d, "part")
    calls = o.join(p, F.col("p_partkey") == F.col("o_custkey") % 50).select(F.concat(F.lit("order:"), "o_orderkey").alias("src"), F.col("p_name").alias("name"))
    methods = nodes(spark, d).where("tier = 3 and kind = 'method'").select("name", F.col("id").alias("method"))
    return joins.unique_dispatch(calls, methods, ["name"], edges(spark, d, "references").select("src", "dst"))


@query("nearest_manifest", "J9", "J10", "J11", sql=N + """
, m AS (SELECT DISTINCT concat('m:', s_suppkey) AS manifest, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'customer' ELSE concat('customer/', s_nationkey) END AS dir, concat('lib', s_suppkey % 4) AS name, (s_suppkey % 4)::INT AS scope_rank FROM supplier),
one AS (SELECT dir, name, arg_min(manifest, (scope_rank, manifest)) AS manifest FROM m GROUP BY 1, 2), e AS (SELECT name, min(manifest) AS first, count(*) AS n FROM one GROUP BY 1), i AS (SELECT id, path, concat('lib', line % 5) AS name FROM nodes WHERE tier = 2),
near AS (SELECT id, i.name, arg_max(manifest, length(dir)) AS near FROM i JOIN one ON i.name = one.name AND (dir = '' OR starts_with(path, dir || '/')) GROUP BY 1, 2)
SELECT i.id, i.name, coalesce(near, first) AS manifest, near IS NULL AND n > 1 AS ambiguous FROM i JOIN e USING (name) LEFT JOIN near ON near.id = i.id""")
def nearest_manifest(spark, d):
    k = F.col("s_suppkey")
    folder = F.when(k % 3 == 0, "").when(k % 3 == 1, "customer").otherwise(F.concat(F.lit("customer/"), "s_nationkey"))
    m = load(spark, d, "supplier").select(F.concat(F.lit("m:"), "s_suppkey").alias("manifest"), folder.alias("dir"), F.concat(F.lit("lib"), k % 4).alias("name"), (k % 4).cast("int").alias("scope_rank"))
    return joins.nearest_manifest(nodes(spark, d).where("tier = 2").select("id", "path", F.concat(F.lit("lib"), F.col("line") % 5).alias("name")), m)


_SITE = "CASE WHEN k % 3 <> 0 THEN concat('topic', k % 40) END AS v, CASE WHEN k % 4 <> 1 THEN concat('NAME', k % 30) END AS i, k % 2 = 0 AS l"


@query("pair_by_name", "J12", "J13", "J16", "J27", sql=f"""
WITH s AS (SELECT k AS sender, nk AS scope, {_SITE} FROM (SELECT s_suppkey AS k, s_nationkey AS nk FROM supplier)), r AS (SELECT k AS receiver, nk AS scope, {_SITE} FROM (SELECT c_custkey AS k, c_nationkey AS nk FROM customer))
SELECT sender, receiver, CASE WHEN s.v = r.v THEN CASE WHEN s.l AND r.l THEN 'literal' ELSE 'constant' END WHEN s.v IS NULL AND r.v IS NULL THEN 'variable' ELSE 'unresolved' END AS kind FROM s JOIN r USING (scope)
WHERE coalesce(s.v = r.v, false) OR (s.v IS NULL OR r.v IS NULL) AND coalesce(s.i = r.i, false)""")
def pair_by_name(spark, d):
    def site(table, key, scope):
        k = F.col(key)
        return load(spark, d, table).select(k, scope, F.when(k % 3 != 0, F.concat(F.lit("topic"), k % 40)), F.when(k % 4 != 1, F.concat(F.lit("NAME"), k % 30)), k % 2 == 0)

    return joins.pair_by_name(site("supplier", "s_suppkey", "s_nationkey"), site("customer", "c_custkey", "c_nationkey"))


@query("query_to_table", "J14", sql=N + """
, t AS (SELECT lower(name) AS key, min(id) AS table_id, count(*) AS n FROM nodes WHERE kind = 'table' GROUP BY 1)
SELECT o_orderkey AS query_id, table_id, CASE WHEN n > 1 THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence, n > 1 AS fallback FROM orders JOIN part ON p_partkey = o_custkey % 60 JOIN t ON key = lower(p_name)""")
def query_to_table(spark, d):
    o, p = load(spark, d, "orders"), load(spark, d, "part")
    mentions = o.join(p, F.col("p_partkey") == F.col("o_custkey") % 60).select(F.col("o_orderkey").alias("query_id"), F.upper("p_name").alias("name"))
    return joins.link_tables(mentions, nodes(spark, d).where("kind = 'table'").select(F.col("id").alias("table_id"), "name"))


@query("operations_to_routes", "J15", sql="""
WITH op AS (SELECT concat('NATION_', n_nationkey) AS operation, concat('/r', n_nationkey % 7, '/:') AS shape, CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM nation),
r AS (SELECT concat('route', n_nationkey) AS route, n_name AS name, concat('/r', n_nationkey % 5, '/:') AS shape, CASE n_nationkey % 3 WHEN 0 THEN 'GET,PUT' WHEN 1 THEN NULL ELSE 'POST' END AS rmethod FROM nation),
p AS (SELECT operation, route, 0.85::DOUBLE AS confidence FROM op JOIN r USING (shape) WHERE rmethod IS NULL OR list_contains(string_split(rmethod, ','), method))
FROM p UNION ALL SELECT operation, route, 0.9::DOUBLE FROM op JOIN r ON name = operation WHERE operation NOT IN (SELECT operation FROM p)""")
def operations_to_routes(spark, d):
    n, k = load(spark, d, "nation"), F.col("n_nationkey")
    ops = n.select(F.concat(F.lit("NATION_"), k).alias("operation"), names.normalize_route(F.concat(F.lit("/r"), k % 7, F.lit("/{id}"))).alias("path"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"))
    routes = n.select(F.concat(F.lit("route"), k).alias("route"), F.col("n_name").alias("name"), names.normalize_route(F.concat(F.lit("/r"), k % 5, F.lit("/<int:key>"))).alias("rpath"), F.when(k % 3 == 0, "GET,PUT").when(k % 3 == 2, "POST").alias("rmethod"))
    return joins.link_operations(ops, routes, names.method_matches(F.col("rmethod"), F.col("method")))


@query("selected_against_ran", "J22", "J23", "U2", sql="""
WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT CASE WHEN a.id IS NULL THEN 'right' WHEN b.id IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""")
def selected_against_ran(spark, d):
    li = load(spark, d, "lineitem")
    part = lambda flag, q: li.where((F.col("l_returnflag") == flag) & (F.col("l_quantity") > q)).select(F.col("l_partkey").alias("id"))
    return joins.compare_sets(part("A", 45), part("R", 40))


@query("overload_choice", "J24", sql=N + """
, c AS (SELECT o_orderkey AS call, p_name AS name, (o_orderkey % 4)::INT AS n_args FROM orders JOIN part ON p_partkey = o_custkey % 50), k AS (SELECT id, name, line % 2 AS tier, line % 3 AS required, CASE WHEN line % 5 = 0 THEN NULL ELSE line % 3 + 1 END AS maximum, path, line FROM nodes WHERE tier = 3),
t AS (SELECT call, tier, arg_min(id, (path, line, id)) AS chosen, count(*) AS n FROM c JOIN k USING (name) WHERE n_args >= required AND (maximum IS NULL OR n_args <= maximum) GROUP BY 1, 2), f AS (SELECT call, arg_min(chosen, tier) AS chosen, arg_min(n, tier) AS n FROM t GROUP BY 1)
SELECT c.call, chosen, coalesce(round(1 / sqrt(n), 6), 0) AS confidence, coalesce(n > 1, false) AS ambiguous FROM c LEFT JOIN f USING (call)""")
def overload_choice(spark, d):
    o, p = load(spark, d, "orders"), load(spark, d, "part")
    calls = o.join(p, F.col("p_partkey") == F.col("o_custkey") % 50).select(F.col("o_orderkey").alias("call"), F.col("p_name").alias("name"), (F.col("o_orderkey") % 4).cast("int").alias("n_args"))
    line = F.col("line")
    cands = nodes(spark, d).where("tier = 3").select("id", "name", (line % 2).alias("tier"), (line % 3).alias("required"), F.when(line % 5 != 0, line % 3 + 1).alias("maximum"), "path", "line")
    return joins.choose_overload(calls, cands, names.admits(F.col("required"), F.col("maximum"), F.col("n_args")))


@query("name_index", "J25", sql=N + "SELECT name, arg_min(id, ((kind <> 'method')::INT, id)) AS id, count(*) > 1 AS fallback FROM nodes WHERE tier = 3 AND name IN (SELECT p_name FROM part WHERE p_size < 10) GROUP BY name")
def name_index(spark, d):
    wanted = load(spark, d, "part").where("p_size < 10").select(F.col("p_name").alias("name"))
    return joins.by_name(wanted, nodes(spark, d).where("tier = 3"), "method")


@query("changed_file_nodes", "J1", sql=N + """
, c AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN concat('geo/', n_regionkey, '/nations.sql') WHEN n_nationkey % 3 = 1 THEN concat(n_regionkey, '/nations.sql') ELSE concat('/repo/geo/', n_regionkey, '/nations.sql') END AS changed FROM nation), p AS (SELECT DISTINCT path FROM nodes),
x AS (SELECT changed, path FROM c JOIN p ON changed = path) FROM x UNION SELECT changed, path FROM c, p WHERE changed NOT IN (SELECT changed FROM x) AND (ends_with(path, '/' || changed) OR ends_with(changed, '/' || path))""")
def changed_file_nodes(spark, d):
    k = F.col("n_nationkey")
    tail = F.concat(F.col("n_regionkey").cast("string"), F.lit("/nations.sql"))
    changed = F.when(k % 3 == 0, F.concat(F.lit("geo/"), tail)).when(k % 3 == 1, tail).otherwise(F.concat(F.lit("/repo/geo/"), tail))
    return joins.suffix_matches(load(spark, d, "nation").select(changed.alias("changed")).distinct(), nodes(spark, d).select("path").distinct())


@query("fallback_hints", "J21", sql="""
SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN concat('m', s_nationkey) WHEN s_suppkey % 4 = 0 THEN concat('m', s_suppkey % 4) WHEN s_suppkey % 4 = 2 THEN 'm2' END AS key FROM supplier WHERE s_nationkey % 2 = 0 OR s_suppkey % 4 IN (0, 2)""")
def fallback_hints(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.concat(F.lit("m"), "s_nationkey"), F.concat(F.lit("m"), F.col("s_suppkey") % 4)).alias("hint"))
    known = load(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("m"), "n_nationkey").alias("key"))
    return joins.first_hint(s, s, known)


@query("unified_files", "J31", "J30", sql=NE + """
, k AS (SELECT path, min(id) AS keep FROM nodes WHERE tier = 2 GROUP BY 1), w AS (SELECT id, keep FROM nodes JOIN k USING (path) WHERE tier = 2), e AS (SELECT coalesce(s.keep, src) AS src, coalesce(t.keep, dst) AS dst, type FROM edges LEFT JOIN w s ON s.id = src LEFT JOIN w t ON t.id = dst WHERE type IN ('contains', 'calls'))
SELECT type, src, count(*) AS n, count(DISTINCT dst) AS targets FROM e GROUP BY 1, 2""")
def unified_files(spark, d):
    out = joins.unify_files(nodes(spark, d).where("tier = 2").select("id", "path"), edges(spark, d, "contains", "calls"))
    return out.groupBy("type", "src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


@query("catalogue_overlay", "E6", "S11", "F17", sql="""
SELECT p_brand AS module, p_type AS name, arg_min(p_partkey, (p_size % 3, p_partkey)) AS row_id, min(p_size % 3)::INT AS origin FROM part WHERE p_size <> 13 GROUP BY 1, 2""")
def catalogue_overlay(spark, d):
    rows = load(spark, d, "part").where("p_size <> 13").select(F.col("p_brand").alias("module"), F.col("p_type").alias("name"), F.col("p_partkey").alias("row_id"), (F.col("p_size") % 3).alias("origin"))
    return joins.precedence(rows, ["module", "name"], ["origin", "row_id"])


@query("external_bases", "J34", "G19", sql="""
SELECT c_custkey, concat('py:external:0-0:base', c_custkey % 40, ':unresolved') AS dst FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_custkey % 40)""")
def external_bases(spark, d):
    c = load(spark, d, "customer").withColumn("base", (F.col("c_custkey") % 40).cast("int"))
    out = c.join(load(spark, d, "nation"), F.col("base") == F.col("n_nationkey"), "left_anti")
    return out.select("c_custkey", F.concat(F.lit("py:external:0-0:base"), "base", F.lit(":unresolved")).alias("dst"))


@query("import_resolution", "J20", sql="""
WITH f AS (SELECT DISTINCT concat('pkg', n_regionkey, '/m', n_nationkey, '.py') AS path FROM nation UNION SELECT concat('pkg', r_regionkey, '.py') FROM region), i AS (SELECT s_suppkey AS id, concat('pkg', s_suppkey % 9) AS folder, CASE WHEN s_suppkey % 4 = 0 THEN concat('m', s_nationkey, '.x') ELSE concat('pkg', s_suppkey % 7, '.m', s_nationkey, '.Thing') END AS module FROM supplier),
c AS (SELECT id, module, folder, string_split(module, '.') AS p FROM i), x AS (SELECT id, module, k, array_to_string(p[1:k], '/') || '.py' AS path, folder FROM c, range(1, 4) t(k) WHERE k <= len(p)), y AS (SELECT id, module, k, path FROM x UNION ALL SELECT id, module, k - 1000, folder || '/' || path FROM x)
SELECT id, module, arg_max(path, k) AS path FROM y WHERE path IN (FROM f) GROUP BY 1, 2""")
def import_resolution(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("pkg"), "n_regionkey", F.lit("/m"), "n_nationkey", F.lit(".py")).alias("path"))
    files = n.union(load(spark, d, "region").select(F.concat(F.lit("pkg"), "r_regionkey", F.lit(".py"))))
    k = F.col("s_suppkey")
    module = F.when(k % 4 == 0, F.concat(F.lit("m"), "s_nationkey", F.lit(".x"))).otherwise(F.concat(F.lit("pkg"), k % 7, F.lit(".m"), "s_nationkey", F.lit(".Thing")))
    return joins.resolve_imports(load(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("pkg"), k % 9).alias("folder"), module.alias("module")), files)


@query("view_templates", "J19", sql="""
SELECT n_nationkey AS view, CASE WHEN n_nationkey % 3 = 0 THEN concat('templates/', lower(n_name), '/index.html') WHEN n_nationkey % 3 = 1 THEN concat(lower(n_name), '.html') END AS path FROM nation WHERE n_nationkey % 3 < 2""")
def view_templates(spark, d):
    n, k = load(spark, d, "nation").withColumn("name", F.lower("n_name")), F.col("n_nationkey")
    files = n.where(k % 3 == 0).select(F.concat(F.lit("templates/"), "name", F.lit("/index.html")).alias("path")).union(n.where(k % 3 < 2).select(F.concat("name", F.lit(".html"))))
    return joins.probe_paths(n.select(k.alias("view"), "name"), ["templates/{name}/index.html", "views/{name}.html", "{name}.html"], files)


@query("library_signatures", "S26", "S12", sql="SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'io.Reader' WHEN 'LARGE' THEN 'net.Conn' END AS returned FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def library_signatures(spark, d):
    rows = spark.createDataFrame([("SMALL", "io.Reader", 1), ("SMALL", "old.Reader", 2), ("LARGE", "net.Conn", 1)], "key string, returned string, origin int")
    catalogue = joins.precedence(rows, ["key"], ["origin"])
    return load(spark, d, "part").join(F.broadcast(catalogue), F.col("p_type") == F.col("key")).select("p_partkey", "returned")
