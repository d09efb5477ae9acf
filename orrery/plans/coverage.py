"""Queries of coverage, costs and differences of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import coverage
from orrery.sources.tables import load

from .register import query

C = "WITH c AS (SELECT DISTINCT l_suppkey AS test, l_partkey AS line FROM lineitem WHERE l_quantity > 40) "
_COSTS = "SELECT s_suppkey AS test, s_nationkey AS grp, abs(s_acctbal) AS setup, 1.5::DOUBLE AS call, (s_suppkey % 3)::DOUBLE AS teardown FROM supplier"


def _covers(spark, d):
    return load(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("line")).distinct()


def _costs(spark, d):
    k = F.col("s_suppkey")
    return load(spark, d, "supplier").select(k.alias("test"), F.col("s_nationkey").alias("grp"), F.abs("s_acctbal").alias("setup"), F.lit(1.5).alias("call"), (k % 3).cast("double").alias("teardown"))


@query("exclusive_lines", "A7", sql=C + ", s AS (SELECT min(test) AS test FROM c GROUP BY line HAVING count(*) = 1) SELECT t.test, (SELECT count(*) FROM s WHERE s.test = t.test) AS n FROM (SELECT DISTINCT test FROM c) t")
def exclusive_lines(spark, d):
    return coverage.exclusive_lines(_covers(spark, d))


@query("cost_model", "A8", sql=f"WITH x AS ({_COSTS}), g AS (SELECT grp, median(setup) AS m, max(setup) AS most FROM x GROUP BY 1) SELECT test, grp, round(call + teardown + m, 6) AS marginal, round(greatest(0, most - m), 6) AS fixed FROM x JOIN g USING (grp)")
def cost_model(spark, d):
    return coverage.cost_model(_costs(spark, d))


def _pick(k: int) -> str:
    return f", p{k} AS (SELECT test, count(*) AS n FROM r{k - 1} GROUP BY test ORDER BY count(*) / greatest(1 + test % 5, 1e-9) DESC, test LIMIT 1), r{k} AS (SELECT * FROM r{k - 1} WHERE line NOT IN (SELECT line FROM r{k - 1} WHERE test = (SELECT test FROM p{k})))"


@query("greedy_cover", "L7", "L10", sql=C + ", r0 AS (FROM c)" + "".join(_pick(k) for k in (1, 2, 3)) + " SELECT 1 AS step, test, n AS new_lines FROM p1 UNION ALL SELECT 2, test, n FROM p2 UNION ALL SELECT 3, test, n FROM p3")
def greedy_cover(spark, d):
    c = _covers(spark, d)
    costs = load(spark, d, "supplier").select(F.col("s_suppkey").alias("test"), (1 + F.col("s_suppkey") % 5).cast("double").alias("cost"))
    return coverage.greedy_cover(c, costs, 3)


@query("redundancy_report", "A9", "A24", sql=C + """
SELECT (SELECT count(DISTINCT test) FROM c) AS measurable, (SELECT count(*) FROM (SELECT s_suppkey + 5 AS t FROM supplier) WHERE t NOT IN (SELECT test FROM c)) AS unmeasured, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS chosen,
       (SELECT count(DISTINCT test) FROM c WHERE test NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)) AS redundant""")
def redundancy_report(spark, d):
    s = load(spark, d, "supplier")
    return coverage.redundancy(_covers(spark, d), s.select((F.col("s_suppkey") + 5).alias("test")), s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("test")))


@query("residual_lines", "U3", sql=C + "SELECT line FROM c GROUP BY line HAVING count(*) FILTER (test % 4 = 0) = 0")
def residual_lines(spark, d):
    return coverage.residual(_covers(spark, d), load(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("test")))


@query("coverage_similarity", "U4", sql=C + """
, g AS (SELECT c.*, s_nationkey AS grp FROM c JOIN supplier ON s_suppkey = test), n AS (SELECT test, count(*) AS n FROM g GROUP BY 1)
SELECT x.test AS a, y.test AS b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS similarity FROM g x JOIN g y ON x.grp = y.grp AND x.line = y.line AND x.test < y.test JOIN n na ON na.test = x.test JOIN n nb ON nb.test = y.test GROUP BY 1, 2""")
def coverage_similarity(spark, d):
    g = _covers(spark, d).join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("test"), F.col("s_nationkey").alias("grp")), "test")
    return coverage.jaccard(g, "grp")


@query("at_risk_blocks", "A30", "U9", sql=C + "SELECT line % 17 AS block, count(*) AS statements FROM (SELECT line FROM c GROUP BY line HAVING count(*) FILTER (test % 4 <> 1) = 0) GROUP BY 1")
def at_risk_blocks(spark, d):
    gone = load(spark, d, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("test"))
    return coverage.at_risk(_covers(spark, d), gone, F.col("line") % 17)


@query("inferred_coverage", "A29", sql="SELECT l_returnflag, round(100.0 * (count(*) - count(*) FILTER (l_tax > 0.06) - count(*) FILTER (l_discount > 0.08)) / nullif(count(*) - count(*) FILTER (l_discount > 0.08), 0), 4) AS percent FROM lineitem GROUP BY 1")
def inferred_coverage(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0.06).alias("missing"), F.count_if(F.col("l_discount") > 0.08).alias("not_rerun"))
    return g.select("l_returnflag", F.round(100.0 * (F.col("n") - F.col("missing") - F.col("not_rerun")) / F.nullif(F.col("n") - F.col("not_rerun"), F.lit(0)), 4).alias("percent"))


@query("statement_changes", "U8", sql="""
SELECT p_partkey AS block, CASE WHEN p_size % 5 = 0 THEN 'new' WHEN p_size % 5 = 1 THEN 'gone' WHEN p_size % 5 = 2 THEN 'whole' WHEN p_size % 5 = 3 THEN 'prose' ELSE 'same' END AS change FROM part""")
def statement_changes(spark, d):
    p, k = load(spark, d, "part"), F.col("p_size") % 5
    digest = F.sha2(F.to_json(F.struct("p_name", "p_brand")), 256)
    old = p.where(k != 0).select(F.col("p_partkey").alias("block"), digest.alias("digest"), F.lit("a").alias("prose"))
    new = p.where(k != 1).select(F.col("p_partkey").alias("block"), F.when(k == 2, F.reverse(digest)).otherwise(digest).alias("digest"), F.when(k == 3, "b").otherwise("a").alias("prose"))
    return coverage.statement_changes(old, new)


@query("added_files", "F19", sql=r"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}{2,}'))) AS name FROM documents), a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT unnest(['the', 'und', 'los']))
SELECT name, min('doc' || lpad(doc_id::VARCHAR, 9, '0')) AS path FROM a LEFT JOIN w USING (name) GROUP BY name""")
def added_files(spark, d):
    from orrery.functions.text import letter_words

    added = load(spark, d, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name")).union(spark.range(1).select(F.explode(F.array(*map(F.lit, ("the", "und", "los")))))).distinct()
    texts = load(spark, d, "documents").select(F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text")
    return coverage.first_mention(added, texts, letter_words(F.col("text")))


@query("merged_limits", "U6", sql="SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS limits_hit FROM nation GROUP BY 1")
def merged_limits(spark, d):
    n = load(spark, d, "nation")
    half = lambda keep: n.where(keep).groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("x"))
    both = half("n_nationkey < 12").withColumnRenamed("x", "a").join(half("n_nationkey >= 12").withColumnRenamed("x", "b"), "n_regionkey", "full_outer")
    none = F.array().cast("array<struct<n_nationkey:int,n_name:string>>")
    joined = F.sort_array(F.concat(F.coalesce("a", none), F.coalesce("b", none)))
    return both.select("n_regionkey", F.transform(joined, lambda x: x["n_name"]).alias("limits_hit"))


@query("content_snapshots", "K5", sql="SELECT sha256(text) AS digest, min(doc_id) AS first_id, octet_length(encode(any_value(text)))::INT AS bytes FROM documents GROUP BY 1 HAVING NOT bool_or(doc_id % 2 = 0)")
def content_snapshots(spark, d):
    from orrery.sources.graphs import unseen

    docs = load(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    fresh = unseen(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "digest")
    return fresh.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first(F.octet_length("text")).alias("bytes"))


@query("dictionary_ids", "K2", sql="SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS node_id FROM customer")
def dictionary_ids(spark, d):
    return coverage.gapless(load(spark, d, "customer").select("c_custkey"), "c_custkey", "node_id", 16)


@query("stored_graph", "K1", "K2", "S4", "S5", sql="WITH g AS (SELECT concat('b', n_regionkey) AS build, n_nationkey AS seq, n_name AS node FROM nation) SELECT build, seq, node FROM g WHERE build = (SELECT max(build) FROM g)")
def stored_graph(spark, d):
    from orrery.sources import graphs

    g = load(spark, d, "nation").select(F.concat(F.lit("b"), "n_regionkey").alias("build"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("node"))
    folder = graphs.new_folder(spark, "graphs")
    graphs.store(g, folder, "build")
    graphs.store(g.where("build = 'b1'"), folder, "build")  # replaces that build alone
    return graphs.newest(spark, folder, "build").select("build", "seq", "node")


@query("graph_verdicts", "F20", sql="""
WITH a AS (SELECT s_nationkey AS k, count(*) FILTER (s_acctbal < -900) AS need_analysis FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) FILTER (c_mktsegment = 'BUILDING') AS extra_tests FROM customer GROUP BY 1),
s AS (SELECT n_nationkey, coalesce(need_analysis, 0) AS need_analysis, coalesce(extra_tests, 0) AS extra_tests FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey)
SELECT *, CASE WHEN need_analysis > 0 THEN 'added_file' WHEN extra_tests > 10 THEN 'too_far_behind' ELSE 'use' END AS verdict FROM s""")
def graph_verdicts(spark, d):
    added = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("s_acctbal") < -900).alias("need_analysis"))
    extra = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("extra_tests"))
    s = load(spark, d, "nation").select("n_nationkey").join(added, "n_nationkey", "left").join(extra, "n_nationkey", "left").fillna(0, ["need_analysis", "extra_tests"])
    return coverage.graph_verdict(s, 10)
