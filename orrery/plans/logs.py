"""Queries of the operation log, evidence logs, retention and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import oplog
from orrery.sources.tables import load, ops

from .register import query, with_

O = with_("ops")


@query("op_log_fold", "T1", "T2", "T4", "T6", "K7", sql=O + """
SELECT item, arg_min(ts, (clock, nonce)) FILTER (op = 'create') AS created, arg_max(priority, (clock, nonce)) FILTER (op IN ('create', 'update')) AS priority, arg_max(status, (clock, nonce)) FILTER (op IN ('create', 'update', 'resolve', 'lock')) AS status,
       coalesce(arg_max(op = 'lock', (clock, nonce)) FILTER (op IN ('lock', 'resolve')), false) AS locked, count(*) FILTER (op = 'discuss') AS discussions FROM ops GROUP BY item HAVING created IS NOT NULL""")
def op_log_fold(spark, d):
    return oplog.fold(ops(spark, d))


@query("tag_sets", "T3", sql=O + "SELECT item, list_sort(list(tag)) AS members FROM (SELECT item, tag, arg_max(op = 'update', (clock, nonce)) AS there FROM ops WHERE op IN ('update', 'resolve') GROUP BY 1, 2) WHERE there GROUP BY item")
def tag_sets(spark, d):
    return oplog.fold_sets(ops(spark, d), "tag", F.col("op") == "update", F.col("op") == "resolve")


@query("discussion_threads", "T5", sql=O + """
, c AS (SELECT item, max(clock) AS clock, max(nonce) FILTER (clock = m) AS nonce FROM (SELECT *, max(clock) OVER (PARTITION BY item) AS m FROM ops WHERE op = 'resolve') GROUP BY item)
SELECT o.item, count(*) AS n FROM ops o LEFT JOIN c USING (item) WHERE op = 'discuss' AND (c.clock IS NULL OR o.clock > c.clock OR o.clock = c.clock AND o.nonce > c.nonce) GROUP BY o.item""")
def discussion_threads(spark, d):
    return oplog.thread(ops(spark, d), F.col("op") == "resolve").groupBy("item").agg(F.count("*").alias("n"))


@query("op_log_union", "U1", "T8", "K8", sql=O + ", a AS (SELECT item, op, event_id FROM ops WHERE event_id % 3 <> 0), b AS (SELECT item, op, event_id FROM ops WHERE event_id % 2 = 0) SELECT item, op, event_id, CASE WHEN event_id % 3 <> 0 THEN 0 ELSE 1 END AS source, event_id AS pos FROM (FROM a UNION FROM b)")
def op_log_union(spark, d):
    o = ops(spark, d).select("item", "op", "event_id", F.col("event_id").alias("pos"))
    return oplog.union_blocks(o.where("event_id % 3 <> 0"), o.where("event_id % 2 = 0"))


_STATE = """, days AS (SELECT DISTINCT item, ts::DATE AS day FROM ops), st AS (
  SELECT d.item, d.day, CASE WHEN count(*) FILTER (op = 'create') > 0 AND arg_max(status, (clock, nonce)) FILTER (op IN ('create', 'update', 'resolve', 'lock')) <> 'done' THEN arg_max(priority, (clock, nonce)) FILTER (op IN ('create', 'update')) END AS priority
  FROM days d JOIN ops o ON o.item = d.item AND o.ts::DATE <= d.day GROUP BY ALL),
ch AS (SELECT item, day, priority FROM (SELECT *, lag(priority) OVER (PARTITION BY item ORDER BY day) AS before FROM st) WHERE priority IS DISTINCT FROM before) """


@query("item_timelines", "W8", sql=O + _STATE + "SELECT item, day, priority FROM ch")
def item_timelines(spark, d):
    return oplog.timeline(ops(spark, d))


@query("priority_trend", "W9", "T10", "X22", "K6", sql=O + _STATE + """
, days2 AS (SELECT unnest(generate_series((SELECT min(day) FROM ch), (SELECT max(day) FROM ch), INTERVAL 1 DAY))::DATE AS day), nx AS (SELECT *, lead(day) OVER (PARTITION BY item ORDER BY day) AS until FROM ch)
SELECT d.day, count(priority) AS open, round(avg(priority), 4) AS mean_priority FROM days2 d LEFT JOIN nx ON nx.day <= d.day AND (until IS NULL OR until > d.day) AND priority IS NOT NULL GROUP BY d.day""")
def priority_trend(spark, d):
    return oplog.trend(oplog.timeline(ops(spark, d)))


@query("evidence_verdict", "A10", "A11", "S10", sql="""
SELECT *, CASE WHEN dangerous > 0 THEN 'disqualified' WHEN commits < 30 THEN 'insufficient' ELSE 'met' END AS verdict FROM (
SELECT count(*) AS observations, count(*) FILTER (t) AS informative, count(DISTINCT sha) FILTER (t) AS commits, coalesce(sum(m) FILTER (t), 0)::BIGINT AS dangerous, count(*) FILTER (t AND m IS NULL) AS unjudgeable
FROM (SELECT value > 5 AS t, user_id % 47 AS sha, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 0 END AS m FROM events))""")
def evidence_verdict(spark, d):
    e = load(spark, d, "events").select((F.col("value") > 5).alias("trustworthy"), (F.col("user_id") % 47).alias("sha"), F.when(F.col("event_id") % 10 != 0, 0).alias("misses"))
    return oplog.evidence(e)


@query("statement_bar", "A12", sql="""
SELECT event_type AS change, count(DISTINCT user_id) AS sets, count(DISTINCT user_id) FILTER (value > 80) AS misses, count(DISTINCT user_id) >= 30 AND count(DISTINCT user_id) FILTER (value > 80) = 0 AS met FROM events GROUP BY 1""")
def statement_bar(spark, d):
    g = load(spark, d, "events").groupBy(F.col("event_type").alias("change")).agg(F.countDistinct("user_id").alias("sets"), F.countDistinct(F.when(F.col("value") > 80, F.col("user_id"))).alias("misses"))
    return g.withColumn("met", (F.col("sets") >= 30) & (F.col("misses") == 0))


@query("blocking_count", "A19", sql=O + "SELECT count(*) AS n FROM ops WHERE status IN ('blocked', 'open')")
def blocking_count(spark, d):
    return ops(spark, d).where("status in ('blocked', 'open')").agg(F.count("*").alias("n"))


@query("retention", "K3", "W3", "S5", sql="""
WITH g AS (SELECT o_orderkey AS id, concat('build', o_custkey % 23) AS build FROM orders), b AS (SELECT build FROM g GROUP BY 1 ORDER BY max(id) DESC LIMIT 4) SELECT id, build FROM g WHERE build IN (FROM b) QUALIFY row_number() OVER (PARTITION BY build ORDER BY id DESC) <= 2""")
def retention(spark, d):
    g = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("build"), F.col("o_custkey") % 23).alias("build"))
    return oplog.retained(g)


@query("log_age", "F21", sql="SELECT user_id, count(*) AS kept, CASE WHEN count(*) > 20 THEN 'use' ELSE 'too_few' END AS verdict FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def log_age(spark, d):
    kept = load(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return kept.groupBy("user_id").agg(F.count("*").alias("kept")).withColumn("verdict", F.when(F.col("kept") > 20, "use").otherwise("too_few"))


@query("durations_log", "S8", "S25", sql="""
SELECT concat('tests/t', user_id, '.py::test') AS test, round(sum(value) FILTER (event_type = 'click'), 4) AS setup, round(sum(value) FILTER (event_type = 'view'), 4) AS call, round(sum(value) FILTER (event_type = 'error'), 4) AS teardown FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id""")
def durations_log(spark, d):
    from orrery.sources.logs import durations

    phase = F.expr("case event_type when 'click' then 'setup' when 'view' then 'call' when 'error' then 'teardown' else 'other' end")
    lines = load(spark, d, "events").select(F.concat(F.format_string("%.4f", F.col("value")), F.lit("s "), phase, F.lit("     tests/t"), "user_id", F.lit(".py::test")).alias("value"))
    return durations(lines)


@query("event_properties", "S1", "S2", sql="SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def event_properties(spark, d):
    from orrery.sources.json import with_fields

    return with_fields(load(spark, d, "events"), "props", "k bigint").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
