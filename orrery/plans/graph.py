"""Queries over the encoded graph: metrics, filters, projections, ranking and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import names
from orrery.operators import aggregates, filters, ranking
from orrery.sources.tables import coded_edges, coded_nodes, decoded, edges, load, nodes

from .register import query, with_

NE = with_("nodes", "edges")
N = with_("nodes")
E = with_("edges")
def _test(path: str = "path") -> str:
    """DuckDB's reason for a test path."""
    return rf"""(CASE
  WHEN regexp_matches({path}, '(^|/)(test_|spec_)[^/]*$') OR regexp_matches({path}, '(?i)(^|/)test-[^/]*$') OR regexp_matches({path}, '(?i)[_.](test|spec)[.][^/]*$') THEN 'test'
  WHEN regexp_matches({path}, '(?i)(^|/)(tests[.]py|tests[.]rs|testonly[.]rs)$') OR regexp_matches({path}, '(?i)[.]test-d[.]tsx?$') OR regexp_matches({path}, 'Tests[.]swift$') OR regexp_matches({path}, '(Tests?|IT)[.](java|kt|scala)$') THEN 'test'
  WHEN regexp_matches({path}, '(?i)(^|/)(mock|fake)_[^/]*$') OR regexp_matches({path}, '(?i)_(mock|fake)([.][^./]*)?$') THEN 'mock'
  ELSE coalesce(list_filter(list_transform(string_split(lower({path}), '/'), lambda p: CASE
    WHEN p IN ('tests', 'test', 't', '__tests__', 'testing', 'testsuite') THEN 'test' WHEN p IN ('fakes', 'mocks', 'testfakes', 'testmocks') THEN 'mock' WHEN p IN ('fixtures', 'testdata', 'testfixtures') THEN 'fixture'
    WHEN p IN ('testutils', 'testutil', 'testhelper', 'testhelpers', 'fv', 'harnesses') THEN 'test_support' WHEN p IN ('bench', 'benches', 'benchmark', 'benchmarks') THEN 'benchmark'
    WHEN regexp_matches(p, '(fakes|mocks)$') THEN 'mock' WHEN regexp_matches(p, '^(test-|testsuite)') THEN 'test' END), lambda r: r IS NOT NULL)[1],
    CASE WHEN regexp_matches({path}, '(?i)(^|/)(inttest|integrationtest|unittest|src/integration)/') OR regexp_matches({path}, '(?i)^spec(/|$)') THEN 'test' END) END)"""


TEST = f"({_test()} IS NOT NULL)"
# Folders and files of which the paths of parts are made, so that every rule meets rows.
FOLDERS = (
    "src", "t/x", "pkg/Mocks", "transportfakes", "lib/fixtures/a", "testdata", "core/testutil", "benches", "test-artifacts/q", "testsuite-providers", "app/intTest/java", "src/integration",
    "spec/models", "airflow/listeners/spec", "docs", "a/b/unitTest/c", "Harnesses", "contest", "latest", "src/integrations",
)
FILES = (
    "main.py", "test_main.py", "test-reach.c", "a_test.go", "main.test.js", "spec_helper.rb", "x.spec.ts", "x_spec.rb", "tests.rs", "testonly.rs", "tests.py", "types.test-d.ts", "RouteTests.swift",
    "TestHelpers.swift", "FooTest.java", "FooIT.kt", "TestConfig.java", "db_mock.go", "fake_clock.rs", "mocked.py", "tests", "bench", "contest.py", "Test_Main.py", "protest.md",
)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_PATHS = f"SELECT p_partkey, {_LIST(FOLDERS)}[1 + p_partkey % {len(FOLDERS)}] || '/' || {_LIST(FILES)}[1 + (p_partkey // {len(FOLDERS)}) % {len(FILES)}] AS path, p_size % 7 AS mark FROM part"
_MARKS = "(CASE mark WHEN 0 THEN 'test' WHEN 1 THEN 'Fact' WHEN 2 THEN 'cfg(test)' WHEN 3 THEN 'cfg(unix)' WHEN 4 THEN 'Override' END IN ('test', 'Fact', 'cfg(test)'))"


def _annotated_paths(spark, d):
    """(p_partkey, path, annotations) of the parts."""
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (1 + i % len(xs)).cast("int"))
    path = F.concat(pick(FOLDERS, k), F.lit("/"), pick(FILES, F.floor(k / len(FOLDERS))))
    a = lambda name, *args: F.array(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, args)).cast("array<string>").alias("args")))
    mark = F.col("p_size") % 7
    annotations = F.when(mark == 0, a("test")).when(mark == 1, a("Fact")).when(mark == 2, a("cfg", "test")).when(mark == 3, a("cfg", "unix")).when(mark == 4, a("Override"))
    return load(spark, d, "part").select(k, path.alias("path"), annotations.alias("annotations"))
DEGREE = """, i AS (SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY 1),
ranked AS (SELECT n.*, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, 2 * coalesce(in_degree, 0) + coalesce(out_degree, 0) AS centrality
           FROM nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id)) """


@query("graph_metrics", "A1", "A3", "S4", "P6", sql=NE + """
SELECT coalesce(n.language, e.language) AS language, coalesce(nodes, 0)::BIGINT AS nodes, coalesce(edges, 0)::BIGINT AS edges, coalesce(files, 0)::BIGINT AS files
FROM (SELECT language, count(*) AS nodes, count(DISTINCT path) AS files FROM nodes GROUP BY 1) n
FULL JOIN (SELECT coalesce(language, 'unknown') AS language, count(*) AS edges FROM edges LEFT JOIN nodes ON src = nodes.id GROUP BY 1) e ON n.language = e.language""")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.metrics_by_language(nodes(spark, d), edges(spark, d))


@query("graph_metrics_by_tier", "A1", sql=NE + """
, pairs AS (SELECT s.tier AS st, t.tier AS dt, count(*) AS n FROM edges e LEFT JOIN nodes s ON e.src = s.id LEFT JOIN nodes t ON e.dst = t.id GROUP BY ALL)
SELECT tier, count(*) AS nodes, coalesce((SELECT sum(n) FROM pairs WHERE st = tier), 0)::BIGINT AS edges, coalesce((SELECT sum(n) FROM pairs WHERE st = tier OR dt = tier), 0)::BIGINT AS edges_incident
FROM nodes GROUP BY tier""")
def graph_metrics_by_tier(spark, d):
    return aggregates.metrics_by_tier(coded_nodes(spark, d), coded_edges(spark, d))


@query("graph_totals", "A1", "A2", "A3", sql=NE + """
SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(DISTINCT path) FROM nodes) AS total_files, count(*) AS total_edges,
       round(avg(confidence), 3) AS avg_confidence, round(quantile_disc(confidence, 0.5), 3) AS median_confidence FROM edges""")
def graph_totals(spark, d):
    return aggregates.totals(nodes(spark, d), edges(spark, d))


@query("confidence_histogram", "A2", sql=E + "SELECT printf('%.2f', confidence) AS bin, count(*) AS n FROM edges GROUP BY 1")
def confidence_histogram(spark, d):
    return aggregates.histogram(edges(spark, d))


@query("metrics_rollup", "A31", "A25", sql=N + "SELECT language, tier, count(*) AS n FROM nodes GROUP BY ROLLUP (language, tier)")
def metrics_rollup(spark, d):
    return nodes(spark, d).rollup("language", "tier").agg(F.count("*").alias("n"))


@query("fold_records", "A4", sql="""
SELECT n_regionkey AS region, length(n_name)::INT AS width, list_sort(list(n_name)) AS names, count(*)::INT AS size FROM nation GROUP BY 1, 2""")
def fold_records(spark, d):
    rows = load(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.length("n_name").alias("width"), F.col("n_name").alias("name"))
    return aggregates.fold(rows, "name", "names")


@query("constant_confidence_guard", "A5", sql=E + """
SELECT type, round(confidence, 9) AS value, count(*) AS n FROM edges GROUP BY 1, 2 HAVING count(*) > 100 AND count(*) FILTER (NOT (type = 'contains' AND confidence = 1.0)) > 0""")
def constant_confidence_guard(spark, d):
    return aggregates.constant_groups(edges(spark, d), "type", 100, (F.col("type") == "contains") & (F.col("confidence") == 1.0))


@query("data_model_rank", "A6", "W11", sql=NE + """
, det AS (SELECT id AS symbol_id, 0.85 AS confidence FROM nodes WHERE kind = 'class' UNION ALL SELECT id, 0.7 FROM nodes WHERE kind IN ('class', 'function') AND name LIKE '%0'),
best AS (SELECT symbol_id, max(confidence)::DOUBLE AS confidence FROM det GROUP BY 1), deg AS (SELECT dst AS symbol_id, count(*) AS in_degree FROM edges GROUP BY 1)
SELECT symbol_id, confidence, coalesce(in_degree, 0) AS in_degree,
       round(least(1.0, confidence + CASE WHEN coalesce(in_degree, 0) > 0 THEN least(0.15, ln(1 + in_degree) / 20) ELSE 0 END) * CASE WHEN n.path LIKE 'tests/%' THEN 0.5 ELSE 1 END, 6) AS rank_score
FROM best LEFT JOIN deg USING (symbol_id) JOIN nodes n ON n.id = symbol_id""")
def data_model_rank(spark, d):
    n = nodes(spark, d)
    found = n.where("kind = 'class'").select(F.col("id").alias("symbol_id"), F.lit(0.85).alias("confidence"))
    named = n.where("kind in ('class', 'function') and name like '%0'").select(F.col("id").alias("symbol_id"), F.lit(0.7).alias("confidence"))
    return aggregates.rank_models(found.union(named), edges(spark, d), n.where("path like 'tests/%'"))


@query("clone_clusters", "A20", sql=N + f"""
, s AS (SELECT *, concat(kind, line % 10) AS shape, {TEST} AS is_test FROM nodes)
SELECT language, shape, count(*) AS members, (count(*) * sum(line))::BIGINT AS burden FROM s GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (NOT is_test) >= 2""")
def clone_clusters(spark, d):
    n = nodes(spark, d).withColumns({"shape": F.concat("kind", (F.col("line") % 10).cast("string")), "loc": F.col("line"), "is_test": filters.is_test_path(F.col("path"))})
    return aggregates.clone_clusters(n)


@query("violation_ratchet", "A27", sql="""
SELECT o_orderstatus AS class, o_orderpriority AS severity, count(*) AS observed, CASE WHEN o_orderpriority = '1-URGENT' THEN 1000000 ELSE 0 END::BIGINT AS allowed,
       count(*) > CASE WHEN o_orderpriority = '1-URGENT' THEN 1000000 ELSE 0 END AS breach FROM orders GROUP BY 1, 2""")
def violation_ratchet(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderstatus").alias("class"), F.col("o_orderpriority").alias("severity"))
    allowed = spark.createDataFrame([(c, "1-URGENT", 1_000_000) for c in "FOP"], "class string, severity string, allowed long")
    return aggregates.violations(rows, allowed)


@query("edge_type_coherence", "A28", sql=NE + """
SELECT e.type, s.kind AS src_kind, t.kind AS dst_kind, count(*) AS n FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id
WHERE NOT (e.type = 'contains' OR (e.type = 'calls' AND s.kind = 'function' AND t.kind = 'method')) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def edge_type_coherence(spark, d):
    kind = coded_nodes(spark, d).select("id", "kind")
    allowed = (F.col("type") == "contains") | ((F.col("type") == "calls") & (F.col("src_kind") == "function") & (F.col("dst_kind") == "method"))
    ends = coded_edges(spark, d).select("src", "dst", "type").join(kind.toDF("src", "src_kind"), "src").join(kind.toDF("dst", "dst_kind"), "dst").where(~allowed)
    return ends.groupBy("type", "src_kind", "dst_kind").agg(F.count("*").alias("n")).where("n >= 2")


@query("tag_usage", "A17", "A18", "X20", sql=with_("ops") + """
SELECT tag, count(*) AS uses, min(ts) AS first_at, max(ts) AS last_at, CASE WHEN tag = 'tag3' THEN 'deprecated' WHEN count(*) > 0 THEN 'active' ELSE 'inactive' END AS status FROM ops GROUP BY tag""")
def tag_usage(spark, d):
    from orrery.sources.tables import ops

    g = ops(spark, d).groupBy("tag").agg(F.count("*").alias("uses"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return g.withColumn("status", names.tag_status(F.col("uses"), F.col("tag") == "tag3"))


@query("pass_statistics", "A22", sql="""
SELECT l_returnflag AS pass, count(*) AS runs, round(sum(l_extendedprice), 2) AS total_ms, round(sum(l_extendedprice) FILTER (l_linestatus = 'F'), 2) AS silent_ms,
       count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1""")
def pass_statistics(spark, d):
    silent = F.col("l_linestatus") == "F"
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("pass")).agg(
        F.count("*").alias("runs"), F.round(F.sum("l_extendedprice"), 2).alias("total_ms"), F.round(F.sum(F.when(silent, F.col("l_extendedprice"))), 2).alias("silent_ms"),
        F.count_if(silent).alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"),
    )


@query("language_quotas", "A23", sql=N + """
, g AS (SELECT language, count(*) AS n FROM nodes GROUP BY 1), s AS (SELECT *, greatest(1, floor(200 * (n / sum(n) OVER ())))::BIGINT AS share FROM g)
SELECT language, n, (share + CASE WHEN row_number() OVER (ORDER BY n DESC, language) <= 200 - sum(share) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM s""")
def language_quotas(spark, d):
    return aggregates.language_quotas(nodes(spark, d), 200)


@query("dominant_language", "A26", sql=N + "SELECT path, arg_min(language, (line, id)) AS language FROM nodes GROUP BY path")
def dominant_language(spark, d):
    return aggregates.dominant_language(nodes(spark, d))


@query("proportional_selection", "W1", sql=NE + DEGREE + """
, g AS (SELECT language, count(*) AS n FROM nodes GROUP BY 1), s AS (SELECT *, greatest(1, floor(200 * (n / sum(n) OVER ())))::BIGINT AS share FROM g),
q AS (SELECT language, share + CASE WHEN row_number() OVER (ORDER BY n DESC, language) <= 200 - sum(share) OVER () THEN 1 ELSE 0 END AS quota FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY centrality DESC, name, id) AS place FROM ranked)
SELECT id, language, centrality FROM p JOIN q USING (language) WHERE place <= quota ORDER BY centrality DESC, name, id LIMIT 200""")
def proportional_selection(spark, d):
    return ranking.select_proportionally(ranking.centrality(nodes(spark, d), edges(spark, d)), 200).select("id", "language", "centrality")


@query("underrepresented_languages", "W2", sql=NE + """
, both_ AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), sides AS (SELECT src AS id, dst AS other FROM both_ UNION ALL SELECT dst, src FROM both_),
m AS (SELECT language, count(*) AS n FROM (SELECT s.language FROM edges e JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst UNION ALL SELECT t.language FROM edges e JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.language <> t.language) GROUP BY 1),
lacking AS (SELECT language FROM (SELECT *, n / sum(n) OVER () AS share FROM m) WHERE share >= 0.02 AND language NOT IN (
  SELECT n.language FROM sides JOIN nodes n ON n.id = other WHERE sides.id LIKE 'region:%' AND other NOT LIKE 'region:%')),
deg AS (SELECT id, count(*) AS degree FROM sides GROUP BY 1)
SELECT language, arg_max(id, (coalesce(degree, 0), id)) AS id FROM nodes LEFT JOIN deg USING (id) WHERE language IN (SELECT * FROM lacking) AND id NOT LIKE 'region:%' GROUP BY 1""")
def underrepresented_languages(spark, d):
    n = coded_nodes(spark, d)
    return ranking.underrepresented(n, coded_edges(spark, d), n.where("label like 'region:%'").select("id"), 0.02)


@query("rank_scores", "W11", sql=NE + DEGREE + """SELECT id, round(0.4 + least(0.35, ln(1 + in_degree) / 20) + least(0.25, ln(1 + out_degree) / 40), 6) AS score FROM ranked WHERE tier <= 2""")
def rank_scores(spark, d):
    r = ranking.centrality(nodes(spark, d), edges(spark, d)).where("tier <= 2")
    return r.select("id", F.round(ranking.rank_boosts(F.lit(0.4), F.col("in_degree"), F.col("out_degree")), 6).alias("score"))


@query("importance_density", "W12", sql=NE + DEGREE + "SELECT path, round(sum(in_degree)::DOUBLE / sum(line), 6) AS density FROM ranked GROUP BY path")
def importance_density(spark, d):
    return ranking.density(ranking.centrality(nodes(spark, d), edges(spark, d)), F.col("line"))


@query("coverage_first_selection", "W13", sql=NE + DEGREE + """
, p AS (SELECT *, centrality / tier AS weight, row_number() OVER (PARTITION BY path ORDER BY centrality / tier DESC, id) AS in_file FROM ranked QUALIFY in_file <= 5),
b AS (SELECT path FROM p WHERE in_file = 1 ORDER BY weight DESC, id LIMIT 30)
SELECT id, path, CASE WHEN in_file = 1 AND path IN (SELECT path FROM b) THEN 1 ELSE 2 END AS phase, round(weight, 6) AS weight FROM p ORDER BY phase, p.weight DESC, id LIMIT 100""")
def coverage_first_selection(spark, d):
    out = ranking.coverage_first(ranking.centrality(nodes(spark, d), edges(spark, d)), 30)
    return out.select("id", "path", "phase", F.round("weight", 6).alias("weight"))


@query("coverage_selection", "G9", sql=NE + DEGREE + """
, w AS (SELECT id, language, centrality, coalesce(sum(centrality) OVER (PARTITION BY language ORDER BY centrality DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(centrality) OVER (PARTITION BY language) AS total FROM ranked)
SELECT id, language, centrality FROM w WHERE before < total * 0.25""")
def coverage_selection(spark, d):
    return ranking.coverage_selection(ranking.centrality(nodes(spark, d), edges(spark, d)), 0.25).select("id", "language", "centrality")


@query("tiered_budget", "L9", "L6", sql=NE + DEGREE + """
, t AS (SELECT *, (length(id) + length(name) + length(path)) // 4 AS tokens FROM ranked),
r AS (SELECT id, language, sum(tokens) OVER (PARTITION BY language ORDER BY centrality DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM t)
SELECT id, language, spent FROM r WHERE spent <= 4000""")
def tiered_budget(spark, d):
    r = ranking.centrality(nodes(spark, d), edges(spark, d)).withColumn("tokens", F.floor((F.length("id") + F.length("name") + F.length("path")) / 4))
    return ranking.within_budget(r, "tokens", [F.desc("centrality"), F.col("id")], 4000, "language").select("id", "language", "spent")


@query("tier_filter_nodes", "F1", sql=N + "SELECT id, CASE WHEN tier = 4 AND name LIKE '%7' THEN 1 ELSE tier END AS tier FROM nodes WHERE tier <= 3 OR name LIKE '%7'")
def tier_filter_nodes(spark, d):
    return filters.tier_filter(nodes(spark, d), edges(spark, d), 3, F.col("name").like("%7"))[0].select("id", "tier")


@query("tier_filter_edges", "F1", "U7", sql=NE + """
, gone AS (SELECT id FROM nodes WHERE tier > 3 AND name NOT LIKE '%7')
SELECT id, src, dst, type FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def tier_filter_edges(spark, d):
    kept = filters.tier_filter(coded_nodes(spark, d), coded_edges(spark, d).select("src", "dst", "type"), 3, F.col("name").like("%7"))[1]
    return kept.select(decoded("src").alias("src"), decoded("dst").alias("dst"), "type").select(F.concat_ws("|", "type", "src", "dst").alias("id"), "src", "dst", "type")


@query("tier_filter_paths", "F1", sql=N + "SELECT DISTINCT path FROM nodes WHERE tier > 3 AND name NOT LIKE '%7'")
def tier_filter_paths(spark, d):
    return filters.tier_filter(nodes(spark, d), edges(spark, d), 3, F.col("name").like("%7"))[2]


@query("noise_filter", "F2", sql=N + "SELECT id FROM nodes WHERE NOT (kind = 'section' AND language IN ('brand_1', 'brand_2') OR kind = 'table' AND language IN ('brand_3') OR kind IN ('link', 'label'))")
def noise_filter(spark, d):
    rules = {"section": ("brand_1", "brand_2"), "table": ("brand_3",)}
    return nodes(spark, d).where(~filters.is_noise(F.col("kind"), F.col("language"), rules)).select("id")


@query("excluded_kinds", "F3", sql=N + """
SELECT id, CASE WHEN kind = 'section' THEN language = 'brand_1' WHEN kind = 'variable' THEN true WHEN kind IN ('function', 'method') THEN name LIKE '%9' ELSE false END AS excluded FROM nodes""")
def excluded_kinds(spark, d):
    role = F.when(F.col("name").like("%9"), "event_subscriber")
    return nodes(spark, d).select("id", filters.is_excluded_kind(F.col("kind"), role, F.col("language"), ("brand_1",)).alias("excluded"))


@query("test_and_example_paths", "F4", "F5", "X21", sql=N + rf"""
SELECT DISTINCT path, {TEST} AS is_test, regexp_matches(lower(path), '(^|/)(examples|example|demos|demo|samples|sample|playground|tutorial|tutorials)/') AS is_example FROM nodes""")
def test_and_example_paths(spark, d):
    return nodes(spark, d).select("path", filters.is_test_path(F.col("path")).alias("is_test"), filters.is_example_path(F.col("path")).alias("is_example")).distinct()


@query("key_symbols", "F6", sql=N + f"SELECT id FROM nodes WHERE kind IN ('module', 'class', 'function', 'method', 'table', 'variable') AND NOT {TEST} AND tier <> 4 AND NOT contains(name, 'test_')")
def key_symbols(spark, d):
    return nodes(spark, d).where(filters.is_key_symbol(F.col("kind"), F.col("path"), F.col("name"), F.col("tier"))).select("id")


@query("test_reasons", "F4", "X21", sql=f"SELECT p_partkey, path, {_test()} AS reason, {TEST} OR coalesce({_MARKS}, false) AS is_test FROM ({_PATHS})")
def test_reasons(spark, d):
    p = _annotated_paths(spark, d)
    return p.select("p_partkey", "path", filters.test_reason(F.col("path")).alias("reason"), filters.is_test_node(F.col("path"), F.col("annotations")).alias("is_test"))


@query("annotated_production_edges", "F6", "F7", sql=f"""
WITH n AS (SELECT concat('part:', p_partkey) AS id, {TEST} OR coalesce({_MARKS}, false) AS is_test FROM ({_PATHS}))
SELECT DISTINCT concat('part:', l_partkey) AS src, concat('supplier:', l_suppkey) AS dst FROM lineitem WHERE concat('part:', l_partkey) NOT IN (SELECT id FROM n WHERE is_test)""")
def annotated_production_edges(spark, d):
    n = _annotated_paths(spark, d).withColumn("id", F.concat(F.lit("part:"), "p_partkey"))
    return filters.production_edges(n, edges(spark, d, "depends_on")).select("src", "dst")


@query("production_edges", "F7", "J29", sql=NE + f"SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE {TEST}) GROUP BY type")
def production_edges(spark, d):
    return filters.production_edges(nodes(spark, d), edges(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("symbol_search", "F18", "L5", sql=N + "SELECT id, name, kind, (SELECT count(*) FROM nodes WHERE contains(lower(name), 'widget')) AS total FROM nodes WHERE contains(lower(name), 'widget') ORDER BY name, id LIMIT 25")
def symbol_search(spark, d):
    return filters.search(nodes(spark, d), "WIDGET", 25)


@query("confidence_band", "F10", "X7", "X8", sql=E + """
SELECT type, count(*) AS n, count(*) FILTER (confidence BETWEEN lo - 1e-9 AND hi + 1e-9) AS inside, round(min(lo + (hi - lo) * confidence), 6) AS least
FROM (SELECT *, CASE type WHEN 'calls' THEN 0.4 ELSE 0.3 END AS lo, CASE type WHEN 'contains' THEN 0.95 WHEN 'references' THEN 0.97 ELSE 0.95 END AS hi FROM edges) GROUP BY type""")
def confidence_band(spark, d):
    bands = {"calls": (0.4, 0.95), "contains": (0.3, 0.95), "references": (0.3, 0.97)}
    low = names.lookup(F.col("type"), {k: v[0] for k, v in bands.items()}, 0.3)
    high = names.lookup(F.col("type"), {k: v[1] for k, v in bands.items()}, 0.95)
    e = edges(spark, d).withColumns({"lo": low, "hi": high})
    return e.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)).alias("inside"), F.round(F.min(names.interpolate(F.col("lo"), F.col("hi"), F.col("confidence"))), 6).alias("least"))


@query("compact_edges", "P1", sql=E + "SELECT id, src, dst, type, line, confidence, CASE WHEN confidence < 1 THEN type END AS evidence_type FROM edges WHERE type <> 'contains'")
def compact_edges(spark, d):
    e = edges(spark, d).where("type <> 'contains'").withColumn("meta", F.struct(F.when(F.col("confidence") < 1, F.col("type")).alias("evidence_type"), F.lit("x").alias("other")))
    return e.select("id", "src", "dst", "type", "line", "confidence", F.col("meta.evidence_type").alias("evidence_type"))


@query("entrypoints_and_features", "P2", "P3", "P4", "P5", sql=with_("nodes", "edges") + """
, o AS (SELECT src, list_sort(list(dst)) AS node_ids FROM edges WHERE type = 'contains' GROUP BY src)
SELECT src AS symbol_id, n.kind, node_ids[1:8] AS node_ids, len(node_ids) AS node_ids_total, greatest(2, least(20, 16000 // 2000))::INT AS cap FROM o JOIN nodes n ON n.id = src""")
def entrypoints_and_features(spark, d):
    cap = names.list_cap(F.lit(16_000))
    o = aggregates.capped_lists(edges(spark, d, "contains"), "src", "dst", 20).join(nodes(spark, d).select(F.col("id").alias("src"), "kind"), "src")
    return o.select(F.col("src").alias("symbol_id"), "kind", F.slice("first", 1, cap).alias("node_ids"), F.col("total").alias("node_ids_total"), cap.cast("int").alias("cap"))


@query("dataflow_scope", "A14", sql="""
SELECT p_brand AS language, count(*) FILTER (p_type = 'SMALL') AS sources, count(*) FILTER (p_type = 'LARGE') AS sinks, count(*) FILTER (p_type = 'PROMO') AS sanitizers, count(*) FILTER (p_type = 'SMALL') > 0 AND count(*) FILTER (p_type = 'LARGE') > 0 AS traced FROM part GROUP BY 1""")
def dataflow_scope(spark, d):
    kinds = {"SMALL": "sources", "LARGE": "sinks", "PROMO": "sanitizers"}
    g = load(spark, d, "part").groupBy(F.col("p_brand").alias("language")).pivot("p_type", list(kinds)).count().fillna(0)
    return g.withColumnsRenamed(kinds).withColumn("traced", (F.col("sources") > 0) & (F.col("sinks") > 0))
