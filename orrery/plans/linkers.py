"""Queries of the linkers, over symbols, calls and source lines made from the tables. Their rows are one SQL text in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import linkers
from orrery.sources.tables import load

from .register import query

def rows(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The rows of an encoding; ``stop`` is the end of a span, ``tags`` and ``decs`` are lists as text."""
    tables = set(re.findall(r"FROM (part|supplier|orders)\b", sql))
    escaped = sql.replace("{", "{{").replace("}", "}}")
    df = spark.sql(re.sub(r"FROM (part|supplier|orders)\b", r"FROM {\1}", escaped), **{t: load(spark, d, t) for t in tables})
    for given, column in (("tags", "concepts"), ("bases_", "bases"), ("mods", "modifiers")):
        if given in df.columns:
            df = df.withColumn(column, F.split(given, ","))
    if "decs" in df.columns:
        df = df.withColumn("decorators", F.transform(F.split("decs", ","), lambda x: F.struct(x.alias("name"), F.array().cast("array<string>").alias("args"))))
    return df.withColumnRenamed("stop", "end")


def _named(calls: str, targets: str, sure: float) -> str:
    """DuckDB: calls (src, key, line) to targets (key, id)."""
    return f"SELECT src, dst, min(line)::INT AS line, (CASE WHEN max(n) > 1 THEN 0.5 ELSE {sure} END)::DOUBLE AS confidence, max(n) > 1 AS fallback FROM ({calls}) JOIN (SELECT key, min(id) AS dst, count(DISTINCT id) AS n FROM ({targets}) GROUP BY key) USING (key) GROUP BY src, dst"


_ROUTES = """SELECT concat('s:', p_partkey) AS id, concat('n', p_partkey) AS name, 'method' AS kind, concat(CASE WHEN p_partkey % 11 = 0 THEN 'tests/' ELSE 'app/' END, p_partkey % 40, '.py') AS path, 'python' AS language,
  CAST(1 + (p_partkey * 7) % 900 AS INT) AS start, CAST(1 + (p_partkey * 7) % 900 + CASE p_size % 4 WHEN 0 THEN 400 WHEN 1 THEN 90 ELSE 3 END AS INT) AS stop,
  CASE p_size % 4 WHEN 0 THEN 'controller' WHEN 1 THEN 'router,controller' ELSE 'route' END AS tags FROM part"""


def _grouped(concept: str) -> str:
    return f"""WITH s AS ({_ROUTES})
SELECT arg_min(c.id, (c.stop - c.start, c.id)) AS src, r.id AS dst, arg_min(c.start, (c.stop - c.start, c.id))::INT AS line, 0.8::DOUBLE AS confidence, false AS fallback
FROM s r JOIN s c ON r.path = c.path AND c.start <= r.start AND r.stop <= c.stop WHERE r.tags = 'route' AND list_contains(string_split(c.tags, ','), '{concept}') AND r.path LIKE 'app/%' GROUP BY r.id"""


@query("controller_routes", "J5", sql=_grouped("controller"))
def controller_routes(spark, d):
    return linkers.grouped_routes(rows(spark, d, _ROUTES), "controller")


@query("router_routes", "J4", sql=_grouped("router"))
def router_routes(spark, d):
    return linkers.grouped_routes(rows(spark, d, _ROUTES), "router")


_REGISTERED = """SELECT concat('s:', p_partkey) AS id, CASE WHEN p_partkey < 300 AND p_partkey % 97 = 0 THEN 'run_all_analyzers' WHEN p_partkey < 300 AND p_partkey % 101 = 0 THEN 'run_all_linkers' ELSE 'f' END AS name,
  concat(CASE WHEN p_partkey % 9 = 0 THEN 'tests/' ELSE 'src/' END, p_partkey % 50, '.py') AS path, CAST(p_partkey % 500 AS INT) AS start,
  CASE p_size % 5 WHEN 0 THEN 'register_analyzer' WHEN 1 THEN 'other,register_linker,register_analyzer' WHEN 2 THEN 'other' WHEN 3 THEN '' END AS decs FROM part"""


@query("decorator_dispatch", sql=f"""WITH s AS ({_REGISTERED}), h AS (SELECT id, CASE WHEN decs = 'register_analyzer' THEN 'run_all_analyzers' ELSE 'run_all_linkers' END AS site FROM s WHERE decs LIKE '%register_%' AND path NOT LIKE 'tests/%')
SELECT s.id AS src, h.id AS dst, start AS line, 0.7::DOUBLE AS confidence, false AS fallback FROM s JOIN h ON s.name = h.site""")
def decorator_dispatch(spark, d):
    return linkers.registry_dispatch(rows(spark, d, _REGISTERED))


# Ten parts are a class and nine members.
_G, _K = "CAST(floor(p_partkey / 10) AS BIGINT)", "p_partkey % 10"
_CLASS = f"CASE {_G} WHEN 5 THEN 'BaseTrigger' ELSE concat('C', {_G}) END"
_PLUGINS = f"""SELECT concat('s:', p_partkey) AS id, CASE WHEN {_K} = 0 THEN {_CLASS} ELSE concat({_CLASS}, '.', CASE {_K} WHEN 1 THEN 'execute' WHEN 2 THEN 'poke' WHEN 3 THEN 'get_conn' WHEN 4 THEN 'run' WHEN 5 THEN 'on_kill' WHEN 6 THEN 'hook' WHEN 7 THEN 'test_connection' WHEN 8 THEN 'pre_execute' ELSE 'helper' END) END AS name,
  CASE WHEN {_K} = 0 THEN 'class' ELSE 'method' END AS kind, concat('plugins/', {_G} % 30, '.py') AS path, 'python' AS language, CAST(p_partkey % 500 AS INT) AS start,
  CASE {_G} % 7 WHEN 0 THEN 'BaseOperator' WHEN 1 THEN 'airflow.hooks.BaseHook,object' WHEN 3 THEN 'x.BaseSensor<T>' WHEN 4 THEN 'BaseTrigger' WHEN 5 THEN 'airflow.BaseTrigger' ELSE 'object' END AS bases_ FROM part"""
_PLUGIN_PARENTS = f"SELECT concat('s:', p_partkey) AS src, concat('s:', 10 * CAST(floor({_G} / 3) AS BIGINT)) AS dst FROM part WHERE {_K} = 0 AND {_G} % 7 IN (2, 6) AND p_partkey > 0"


@query("airflow_dispatch", "J28", sql=f"""WITH RECURSIVE s AS ({_PLUGINS}), i AS ({_PLUGIN_PARENTS}), c AS (SELECT id, name, path, start, bases_ FROM s WHERE kind = 'class'),
u(class, id) AS (SELECT id, id FROM c UNION SELECT class, dst FROM u JOIN i ON src = id),
b AS (SELECT class, CASE WHEN bases_ LIKE '%BaseOperator%' THEN 'execute,execute_complete,pre_execute,post_execute,on_kill' WHEN bases_ LIKE '%BaseHook%' THEN 'get_conn,test_connection' WHEN bases_ LIKE '%BaseSensor%' THEN 'poke,execute,execute_complete,on_kill' WHEN bases_ LIKE '%BaseTrigger%' THEN 'run,hook' END AS called,
  bases_ = 'BaseTrigger' AND EXISTS (FROM c WHERE name = 'BaseTrigger') AS open FROM u JOIN c ON c.id = u.id),
m AS (SELECT class, unnest(string_split(string_agg(called, ','), ',')) AS method, bool_or(open) AS open FROM b WHERE called IS NOT NULL GROUP BY class)
SELECT DISTINCT class AS src, s.id AS dst, c.start AS line, (CASE WHEN open THEN 0.5 ELSE 0.9 END)::DOUBLE AS confidence, open AS fallback FROM m JOIN c ON c.id = class JOIN s ON s.kind = 'method' AND s.path = c.path AND s.name = concat(c.name, '.', method)""")
def airflow_dispatch(spark, d):
    return linkers.base_dispatch(rows(spark, d, _PLUGINS), rows(spark, d, _PLUGIN_PARENTS), linkers.AIRFLOW, ("airflow.",), "python")


_MODULES = f"""SELECT concat('s:', p_partkey) AS id, CASE WHEN {_K} = 0 THEN concat('S', {_G}) ELSE concat('S', {_G}, '.', CASE {_K} WHEN 1 THEN CASE WHEN {_G} % 3 = 0 THEN 'Other' ELSE 'CaddyModule' END WHEN 2 THEN 'Provision' WHEN 3 THEN 'ServeHTTP' WHEN 4 THEN 'helper' WHEN 5 THEN 'Stop' ELSE 'Validated' END) END AS name,
  CASE WHEN {_K} = 0 THEN CASE WHEN {_G} % 5 = 0 THEN 'interface' ELSE 'struct' END ELSE 'method' END AS kind, concat('m/', {_G} % 20, '.go') AS path, CASE WHEN {_G} % 8 = 7 THEN 'rust' ELSE 'go' END AS language, CAST(p_partkey % 500 AS INT) AS start FROM part"""


@query("module_dispatch", "J28", sql=f"""WITH s AS ({_MODULES})
SELECT m.id AS src, h.id AS dst, m.start AS line, 0.9::DOUBLE AS confidence, false AS fallback FROM s c JOIN s m ON m.name = c.name || '.CaddyModule' AND m.path = c.path JOIN s h ON h.path = c.path AND h.name IN (c.name || '.Provision', c.name || '.ServeHTTP', c.name || '.Stop') WHERE c.kind = 'struct' AND c.language = 'go'""")
def module_dispatch(spark, d):
    return linkers.module_dispatch(rows(spark, d, _MODULES))


_TRAITS = f"""SELECT concat('s:', p_partkey) AS id, CASE WHEN {_K} = 0 THEN concat('T', {_G}) ELSE concat('T', {_G}, '::m', {_K}) END AS name,
  CASE WHEN {_K} = 0 THEN CASE WHEN {_G} % 4 = 0 THEN 'trait' ELSE 'struct' END WHEN {_G} % 8 = 0 OR {_G} % 4 = 0 AND {_K} > 3 THEN 'field' ELSE 'method' END AS kind, concat('t/', {_G} % 25, '.rs') AS path, 'rust' AS language, CAST(p_partkey % 500 AS INT) AS start FROM part"""
_IMPLEMENTS = f"SELECT concat('s:', p_partkey) AS src, concat('s:', 40 * CAST(floor({_G} / 4) AS BIGINT)) AS dst FROM part WHERE {_K} = 0 AND {_G} % 4 <> 0"


@query("trait_dispatch", "J28", sql=f"""WITH s AS ({_TRAITS}), i AS ({_IMPLEMENTS})
SELECT t.id AS src, m.id AS dst, t.start AS line, 0.85::DOUBLE AS confidence, false AS fallback FROM i JOIN s c ON c.id = i.src JOIN s t ON t.id = i.dst JOIN s m ON m.kind = 'method' AND m.path = c.path AND starts_with(m.name, c.name || '::')
WHERE NOT EXISTS (FROM s r WHERE r.kind = 'method' AND r.name = concat(t.name, '::', string_split(m.name, '::')[2]) AND r.path = t.path)""")
def trait_dispatch(spark, d):
    return linkers.trait_dispatch(rows(spark, d, _TRAITS), rows(spark, d, _IMPLEMENTS))


_BEANS = f"""SELECT concat('s:', p_partkey) AS id, CASE WHEN {_K} = 0 THEN concat('B', {_G}) ELSE concat('B', {_G}, '.', CASE {_K} WHEN 1 THEN 'getName' WHEN 2 THEN 'setName' WHEN 3 THEN 'isOpen' WHEN 4 THEN 'issue' WHEN 5 THEN 'get' WHEN 6 THEN 'settle' ELSE concat('getX', {_K}) END) END AS name,
  CASE WHEN {_K} = 0 THEN 'class' ELSE 'method' END AS kind, concat('b/', {_G} % 25, '.java') AS path, CASE WHEN {_G} % 6 = 5 THEN 'python' WHEN {_G} % 6 = 4 THEN 'kotlin' ELSE 'java' END AS language, CAST(p_partkey % 500 AS INT) AS start,
  CASE WHEN {_K} = 0 AND {_G} % 5 = 0 THEN 'Deprecated,javax.persistence.Entity' WHEN {_K} = 0 AND {_G} % 5 = 1 THEN 'JsonInclude' WHEN {_K} = 4 AND {_G} % 7 = 3 THEN 'JsonValue' WHEN {_K} = 1 THEN 'Override' END AS decs FROM part"""


@query("bean_dispatch", "J28", sql=f"""WITH s AS ({_BEANS}), c AS (SELECT * FROM s c WHERE kind = 'class' AND language <> 'python' AND (decs IN ('Deprecated,javax.persistence.Entity', 'JsonInclude') OR EXISTS (FROM s m WHERE m.name = c.name || '.issue' AND m.path = c.path AND m.decs = 'JsonValue')))
SELECT c.id AS src, m.id AS dst, c.start AS line, 0.9::DOUBLE AS confidence, false AS fallback FROM c JOIN s m ON m.kind = 'method' AND m.path = c.path AND regexp_matches(m.name, concat('^', c.name, '[.](get|set|is)[A-Z]'))""")
def bean_dispatch(spark, d):
    return linkers.bean_dispatch(rows(spark, d, _BEANS))


_NATIVE = """SELECT concat('j:', p_partkey) AS id, CASE p_size % 3 WHEN 0 THEN concat('C', p_partkey % 70, '.run_it') WHEN 1 THEN concat('org.p', p_partkey % 5, '.C', p_partkey % 70, '.run_it') ELSE concat('C', p_partkey % 70, '.other') END AS name,
  'method' AS kind, 'java' AS language, CAST(p_partkey % 500 AS INT) AS start, CASE WHEN p_size % 4 = 0 THEN 'public' ELSE 'public,native' END AS mods FROM part
UNION ALL SELECT concat('c:', s_suppkey), CASE WHEN s_suppkey % 4 = 0 THEN concat('Java_C', s_suppkey % 70, '_run_1it') ELSE concat('Java_org_p', s_suppkey % 5, '_C', s_suppkey % 70, '_run_1it') END, 'function', CASE s_suppkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'cpp' ELSE 'rust' END, 1, '' FROM supplier"""


@query("native_bridge", "J27", sql=f"WITH s AS ({_NATIVE}), e AS (SELECT id, replace(replace(replace(substr(name, 6), '_1', '+'), '_', '.'), '+', '_') AS full_ FROM s WHERE kind = 'function') " + _named("SELECT id AS src, name AS key, start AS line FROM s WHERE mods = 'public,native'", "SELECT full_ AS key, id FROM e UNION SELECT regexp_extract(full_, '[^.]*[.][^.]*$'), id FROM e", 0.95))
def native_bridge(spark, d):
    return linkers.native_bridge(rows(spark, d, _NATIVE))


_FOREIGN = "SELECT concat('c:', s_suppkey) AS id, concat('fn', s_suppkey % 60) AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'macro' ELSE 'function' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'cpp' ELSE 'go' END AS language FROM supplier"
_UNRESOLVED = "SELECT concat('order:', o_orderkey) AS src, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'go:x:0-0:fn' ELSE 'go:C:0-0:fn' END, o_custkey % 90, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ':unresolved' END) AS dst, CAST(o_orderkey % 400 AS INT) AS line FROM orders"
_C = "SELECT name AS key, id FROM s WHERE language IN ('c', 'cpp') AND kind = 'function'"


@query("unresolved_bridge", "J27", sql=f"WITH s AS ({_FOREIGN}), u AS ({_UNRESOLVED}) " + _named("SELECT src, regexp_extract(dst, '^go:C:0-0:(.*):unresolved$', 1) AS key, line FROM u WHERE dst LIKE 'go:C:0-0:%:unresolved'", _C, 0.9))
def unresolved_bridge(spark, d):
    return linkers.unresolved_bridge(rows(spark, d, _UNRESOLVED), rows(spark, d, _FOREIGN))


_LUA = """SELECT concat('l/', p_partkey % 200, '.lua') AS path, CASE WHEN p_partkey % 13 = 0 THEN 'python' ELSE 'lua' END AS language, CAST(p_partkey AS INT) AS line,
  CASE p_size % 5 WHEN 0 THEN concat('local lib', p_partkey % 3, ' = ffi.load("m")') WHEN 1 THEN concat('x = lib', p_partkey % 3, '.fn', p_partkey % 60, '(x) + other.fn4(1)') WHEN 2 THEN concat('ffi.C.fn', p_partkey % 60, '(1) + ffi.C._fn1 (2)') ELSE 'return' END AS text FROM part"""


@query("library_bridge", "J27", sql=f"""WITH s AS ({_FOREIGN}), l AS (SELECT * FROM ({_LUA}) WHERE language = 'lua'), v AS (SELECT DISTINCT path, regexp_extract(text, '(lib[0-9]) = ffi.load', 1) AS var FROM l WHERE text LIKE '%ffi.load%') """ + _named("SELECT path AS src, regexp_extract(text, 'ffi[.]C[.](fn[0-9]+)', 1) AS key, line FROM l WHERE text LIKE 'ffi.C%' UNION ALL SELECT path, regexp_extract(text, 'lib[0-9][.](fn[0-9]+)', 1), line FROM l JOIN v USING (path) WHERE starts_with(text, concat('x = ', var, '.'))", _C, 0.85))
def library_bridge(spark, d):
    return linkers.library_bridge(rows(spark, d, _LUA), rows(spark, d, _FOREIGN))


_CONTRACT = "SELECT concat('k:', s_suppkey) AS id, concat('Token', s_suppkey % 4, '.fn', s_suppkey % 60) AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'event' ELSE 'function' END AS kind, 'solidity' AS language FROM supplier"
_CALLING = """SELECT concat('w/', p_partkey % 60, '.ts') AS path, CASE WHEN p_partkey % 13 = 0 THEN 'go' ELSE 'typescript' END AS language, CAST(p_partkey AS INT) AS line,
  CASE p_size % 3 WHEN 0 THEN concat('await token.fn', p_partkey % 60, '(a)') WHEN 1 THEN concat('read({ functionName: ''fn', p_partkey % 60, ''' })') ELSE concat('fn', p_partkey % 60, '(b)') END AS text FROM part"""


@query("contract_bridge", "J27", sql=f"""WITH s AS ({_CONTRACT}), c AS (SELECT path, regexp_extract(text, 'fn[0-9]+') AS name, min(line) AS line FROM ({_CALLING}) WHERE language = 'typescript' AND (text LIKE 'await%' OR text LIKE 'read%') GROUP BY 1, 2)
SELECT path AS src, id AS dst, line::INT AS line, 0.75::DOUBLE AS confidence, false AS fallback FROM c JOIN s ON string_split(s.name, '.')[2] = c.name WHERE kind = 'function'""")
def contract_bridge(spark, d):
    return linkers.contract_bridge(rows(spark, d, _CALLING), rows(spark, d, _CONTRACT))


_PARTS_OF_PAGES = """SELECT concat('s:', p_partkey) AS id, concat(CASE WHEN p_size % 4 = 0 THEN 'use' ELSE 'Box' END, p_partkey % 90) AS name, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind, concat('ui/', p_partkey % 25, '.tsx') AS path,
  CASE WHEN p_partkey % 17 = 0 THEN 'go' ELSE 'typescript' END AS language, CAST((p_partkey * 3) % 400 AS INT) AS start, CAST((p_partkey * 3) % 400 + 5 + p_size AS INT) AS stop, CASE WHEN p_size % 8 = 0 THEN 'React.Component' ELSE 'object' END AS bases_ FROM part"""
_TAGS = """SELECT concat('ui/', p_partkey % 25, '.tsx') AS path, 'typescript' AS language, CAST((p_partkey * 11) % 450 AS INT) AS line, CASE p_size % 3 WHEN 0 THEN concat('<Box', p_partkey % 90, ' on={x} />') WHEN 1 THEN concat('<div><use', p_partkey % 90, '>') ELSE concat('return < Box', p_partkey % 90, '>') END AS text FROM part"""


@query("component_usage", sql=f"""WITH s AS ({_PARTS_OF_PAGES}), t AS (SELECT DISTINCT path, line, regexp_extract(text, 'Box[0-9]+') AS key FROM ({_TAGS}) WHERE text LIKE '%Box%'),
a AS (SELECT t.*, (SELECT arg_min(id, (stop - start, id)) FROM s WHERE s.path = t.path AND language = 'typescript' AND t.line BETWEEN start AND stop) AS src FROM t) """ + _named("SELECT coalesce(src, path) AS src, key, line FROM a", "SELECT name AS key, id FROM s WHERE language = 'typescript' AND kind IN ('class', 'function') AND (name LIKE 'Box%' OR kind = 'class' AND bases_ = 'React.Component')", 0.8))
def component_usage(spark, d):
    return linkers.component_usage(rows(spark, d, _TAGS), rows(spark, d, _PARTS_OF_PAGES))


_TEMPLATES = """SELECT concat('s:', p_partkey) AS id, CASE WHEN p_size % 3 = 0 THEN '@click' ELSE concat('App.on', p_partkey % 20) END AS name, CASE p_size % 3 WHEN 0 THEN 'directive' WHEN 1 THEN 'method' ELSE 'getter' END AS kind, concat('v/', p_partkey % 40, '.vue') AS path,
  CASE WHEN p_size % 3 = 0 THEN 'vue' WHEN p_partkey % 19 = 0 THEN 'css' ELSE 'javascript' END AS language, CAST(p_partkey % 500 AS INT) AS start, CASE WHEN p_size % 6 = 0 THEN concat('on', p_partkey % 20) END AS handler FROM part"""


@query("template_handlers", sql=f"""WITH s AS ({_TEMPLATES})
SELECT a.id AS src, min(b.id) AS dst, min(a.start)::INT AS line, 0.9::DOUBLE AS confidence, false AS fallback FROM s a JOIN s b ON a.path = b.path AND b.language = 'javascript' AND b.name = concat('App.', a.handler) WHERE a.kind = 'directive' GROUP BY a.id""")
def template_handlers(spark, d):
    return linkers.template_handlers(rows(spark, d, _TEMPLATES))


_CLIENTS = """SELECT concat('f:', p_partkey % 500) AS src, CAST(p_partkey AS INT) AS line, CASE p_size % 4 WHEN 0 THEN concat('query Get', p_partkey % 120, ' { users { id } }') WHEN 1 THEN concat('mutation { add', p_partkey % 30, ' (x: 1) { id } }') WHEN 2 THEN concat(' { users', p_partkey % 30, ' }') ELSE concat('Subscription On', p_partkey % 120, ' { tick }') END AS text FROM part"""
_OPERATIONS = "SELECT concat('o:', s_suppkey) AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('Get', s_suppkey % 80) ELSE concat('On', s_suppkey % 60) END AS name FROM supplier"
_FIELDS = "SELECT concat('q:', s_suppkey) AS id, CASE s_suppkey % 4 WHEN 0 THEN concat('Query.users', CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE concat('', s_suppkey % 30) END) WHEN 1 THEN concat('Mutation.add', s_suppkey % 30) WHEN 2 THEN 'Subscription.tick' ELSE 'User.id' END AS name FROM supplier"


@query("graph_calls", sql=f"""WITH d AS (SELECT *, regexp_extract(text, '(?i)^(query|subscription) ([A-Za-z0-9]+)', 2) AS name, concat(CASE WHEN text LIKE 'mutation%' THEN 'Mutation' WHEN text LIKE 'Sub%' THEN 'Subscription' ELSE 'Query' END, '.', regexp_extract(text, '[{{] ([A-Za-z0-9]+)', 1)) AS field FROM ({_CLIENTS})), o AS ({_OPERATIONS}), f AS ({_FIELDS}) """ + _named("SELECT src, name AS key, line FROM d WHERE name <> ''", "SELECT name AS key, id FROM o", 0.9) + " UNION ALL " + _named("SELECT src, field AS key, line FROM d WHERE name NOT IN (SELECT name FROM o)", "SELECT name AS key, id FROM f", 0.8))
def graph_calls(spark, d):
    return linkers.graph_calls(rows(spark, d, _CLIENTS), rows(spark, d, _OPERATIONS), rows(spark, d, _FIELDS))


_DECORATED = "SELECT concat('s:', p_partkey) AS id, CASE p_size % 6 WHEN 0 THEN 'app.get,login' WHEN 1 THEN 'router.post' WHEN 2 THEN 'GetMapping,RestController' WHEN 3 THEN 'app.gets' WHEN 4 THEN 'app.route,app.route' END AS decs FROM part"
_PATTERNS = [
    ("web", "route", r"^(app|router)\.(get|post|put|delete|patch)$", r"\.(\w+)$"),
    ("web", "route", r"^app\.route$", r"^(none)$"),
    ("beans", "route", r"^(Get|Post|Put|Delete)Mapping$", r"^(\w+)Mapping$"),
    ("beans", "controller", r"^(Rest)?Controller$", r"^(Rest)"),
]


@query("framework_concepts", "E4", sql=f"""WITH s AS ({_DECORATED}), d AS (SELECT id, unnest(string_split(decs, ',')) AS name FROM s WHERE decs IS NOT NULL)
SELECT DISTINCT id, CASE WHEN name LIKE 'app%' OR name LIKE 'router%' THEN 'web' ELSE 'beans' END AS framework, CASE WHEN name = 'RestController' THEN 'controller' ELSE 'route' END AS concept,
  CASE name WHEN 'app.get' THEN 'get' WHEN 'router.post' THEN 'post' WHEN 'GetMapping' THEN 'Get' WHEN 'RestController' THEN 'Rest' ELSE '' END AS value FROM d WHERE name IN ('app.get', 'router.post', 'GetMapping', 'RestController', 'app.route')""")
def framework_concepts(spark, d):
    return linkers.concepts(rows(spark, d, _DECORATED), _PATTERNS)
