"""Queries of manifests, symbol indexes, analyzers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import closure, joins
from orrery.sources import blocks, graphs, json, logs, manifests, sqlite, symbols
from orrery.sources.tables import edges, load, nodes, ops
from orrery.streaming import log

from .register import query, with_


@query("manifest_dependencies", "S17", "S18", "S19", "S20", sql="""
SELECT concat(p_partkey, '/', unnest(['package.json', 'package.json', 'pyproject.toml', 'pyproject.toml', 'pom.xml', 'build.gradle', 'build.gradle', 'mix.exs'])) AS path,
       unnest([lower(p_type), 'jest', lower(p_type), 'hatchling', concat('org.x:', lower(p_type)), concat('org.y:', lower(p_type)), 'org.t:junit', lower(p_type)]) AS name,
       unnest(['^1.2', '29', '>=2', '', '3.1', '4', '5', '~> 1.0']) AS version, unnest(['runtime', 'dev', 'runtime', 'build', 'runtime', 'runtime', 'dev', 'runtime']) AS scope FROM part""")
def manifest_dependencies(spark, d):
    t = F.lower("p_type")
    texts = {
        "package.json": F.format_string('{"name": "x", "dependencies": {"%s": "^1.2"}, "devDependencies": {"jest": "29"}}', t),
        "pyproject.toml": F.format_string('[build-system]\nrequires = ["hatchling"]\n[project]\nname = "x"\ndependencies = [\n  "%s[extra]>=2",\n]\n', t),
        "pom.xml": F.format_string("<project><dependencies><dependency><groupId>org.x</groupId>\n<artifactId>%s</artifactId><version>3.1</version></dependency></dependencies></project>", t),
        "build.gradle": F.format_string("dependencies {\n implementation 'org.y:%s:4'\n testImplementation(\"org.t:junit:5\")\n}", t),
        "mix.exs": F.format_string('defp deps do [{:%s, "~> 1.0"}] end', t),
    }
    rows = F.array(*[F.struct(F.concat_ws("/", "p_partkey", F.lit(k)).alias("path"), v.alias("text")) for k, v in texts.items()])
    return manifests.dependencies(load(spark, d, "part").select(F.inline(rows)))


@query("build_targets", "S21", sql="SELECT p_partkey, 'build' AS target, concat('make ', p_type) AS command FROM part UNION ALL SELECT p_partkey, 'test', 'pytest' FROM part")
def build_targets(spark, d):
    text = F.format_string('{"scripts": {"build": "make %s", "test": "pytest"}}', F.col("p_type"))
    return load(spark, d, "part").select("p_partkey", F.inline(manifests.npm_scripts(text)).alias("target", "command"))


@query("page_symbols", "S22", "E1", "E2", sql=r"""
SELECT url AS path, unnest(l) AS target, unnest(range(len(l)))::INT AS pos, 'links' AS origin FROM (SELECT url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def page_symbols(spark, d):
    return symbols.run_analyzers(load(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")), ("links",))


@query("annotation_edges", "E7", sql="SELECT concat('f', n_nationkey) AS path, unnest([concat('mod.', lower(n_name)), 'b2']) AS target, unnest([0, 1])::INT AS pos FROM nation")
def annotation_edges(spark, d):
    text = F.concat(F.lit("# @calls: mod."), F.lower("n_name"), F.lit("\nx()  # @calls:b2"))
    return symbols.annotations(load(spark, d, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("path"), text.alias("text")))


@query("symbol_monikers", "S13", "S16", sql="""
SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'scip-python' END AS scheme, CASE WHEN p_size % 3 < 2 THEN lower(p_type) END AS package, CASE WHEN p_size % 3 = 0 THEN 'a/b/C#' WHEN p_size % 3 = 1 THEN 'a/' END AS owner,
       CASE p_size % 3 WHEN 0 THEN 'run' WHEN 1 THEN 'Kind' ELSE concat('', p_size) END AS name, CASE p_size % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'type' END AS suffix FROM part""")
def symbol_monikers(spark, d):
    k = F.col("p_size") % 3
    head = F.concat(F.lit("scip-python pypi "), F.lower("p_type"), F.lit(" 1.0 "))
    s = F.when(k == 0, F.concat(head, F.lit("a/b/C#run()."))).when(k == 1, F.concat(head, F.lit("a/Kind#"))).otherwise(F.concat(F.lit("local "), "p_size"))
    return load(spark, d, "part").select("p_partkey", symbols.moniker(s).alias("m")).select("p_partkey", "m.scheme", "m.package", "m.owner", "m.name", "m.suffix")


@query("relationship_edges", "S14", "J32", sql="""
SELECT concat('id', s_suppkey) AS src, CASE WHEN EXISTS (SELECT 1 FROM supplier t WHERE t.s_suppkey = s.s_suppkey + 7) THEN concat('id', s_suppkey + 7) ELSE concat('py:external:0-0:sym', s_suppkey + 7, ':unresolved') END AS dst, unnest(CASE WHEN s_nationkey % 2 = 0 THEN ['implements', 'references'] ELSE ['references'] END) AS type FROM supplier s""")
def relationship_edges(spark, d):
    s = load(spark, d, "supplier")
    sym = lambda c: F.concat(F.lit("sym"), c)
    index = s.select(sym("s_suppkey").alias("symbol"), F.array(F.struct(sym(F.col("s_suppkey") + 7).alias("symbol"), (F.col("s_nationkey") % 2 == 0).alias("implements"), F.lit(True).alias("references"))).alias("relationships"))
    return symbols.relationship_edges(index, s.select(sym("s_suppkey").alias("symbol"), F.concat(F.lit("id"), "s_suppkey").alias("id")))


@query("masked_comments", "F15", "F22", sql="""
SELECT p_partkey, concat('x = "# no" ', repeat(' ', 2 + length(p_name)), chr(10), 'y') AS code, CASE WHEN p_size % 2 = 0 THEN 'objc' ELSE 'c_family' END AS owner FROM part""")
def masked_comments(spark, d):
    source = F.concat(F.lit('x = "# no" # '), "p_name", F.lit("\ny"))
    header = F.when(F.col("p_size") % 2 == 0, "\n@interface X\n").otherwise("int x; // @interface")
    return load(spark, d, "part").select("p_partkey", symbols.mask_comments(source).alias("code"), symbols.header_owner(header).alias("owner"))


@query("stale_cache", "T7", "K7", sql="SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def stale_cache(spark, d):
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    sources = c.select(k.alias("id"), F.lit(2).alias("mtime"))
    cache = c.where(k % 7 != 0).select(k.alias("id"), F.when(k % 5 == 0, 1).otherwise(2).alias("mtime"))
    return graphs.stale(sources, cache)


@query("streamed_fold", "T1", sql=with_("ops") + "SELECT item, arg_max(priority, (clock, nonce)) AS priority, count(*) AS n FROM ops GROUP BY item")
def streamed_fold(spark, d):
    schema = load(spark, d, "events").schema
    e = log.event_stream(spark, f"{d}/events.parquet", schema)
    folder = graphs.new_folder(spark, "fold")
    out = log.run_to_table(log.fold_stream(ops(spark, d, e)), folder, "update")
    return out.groupBy("item").agg(F.max_by("priority", "batch").alias("priority"), F.max_by("n", "batch").alias("n"))


@query("streamed_evidence", "T9", "K4", sql="SELECT user_id AS sha, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_evidence(spark, d):
    schema = load(spark, d, "events").schema
    e = log.event_stream(spark, f"{d}/events.parquet", schema).select("ts", F.col("user_id").alias("sha"), F.col("event_id").alias("observation"))
    folder = graphs.new_folder(spark, "evidence")
    # Update mode gives a day's count whenever it changes; the last batch has the final one.
    out = log.run_to_table(log.evidence_stream(e), folder, "update")
    return out.groupBy("sha", "day").agg(F.max_by("n", "batch").alias("n"))


def _folder(spark, name: str) -> str:
    return f"{closure.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("junit_cases", "S9", sql="SELECT concat_ws('::', concat('pkg.', lower(c_mktsegment), '<&'), concat(c_name, '\"x\"')) AS test, c_custkey % 7 = 0 AS failed FROM customer")
def junit_cases(spark, d):
    folder = _folder(spark, "junit")
    c = load(spark, d, "customer").select(F.concat(F.lit("pkg."), F.lower("c_mktsegment"), F.lit("<&")).alias("classname"), F.concat("c_name", F.lit('"x"')).alias("name"), (F.col("c_custkey") % 7 == 0).alias("failed"))
    logs.write_junit(c, folder)
    return logs.read_junit(spark, folder)


@query("stored_survey", "S1", "S2", "S3", sql=with_("nodes", "edges") + "SELECT n.id, n.name, n.path, n.tier::INT AS tier, coalesce(e.n, 0) AS edges FROM nodes n LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE type = 'contains' AND src LIKE 'region:%' GROUP BY 1) e ON e.src = n.id WHERE n.id LIKE 'region:%' OR n.id LIKE 'nation:%'")
def stored_survey(spark, d):
    """A survey document of regions and nations, written gzipped, found by its name and read strictly."""
    n = nodes(spark, d).where("id like 'region:%' or id like 'nation:%'")
    e = edges(spark, d, "contains").where("src like 'region:%'")
    folder = _folder(spark, "survey")
    json.write_document(n, e, folder)
    doc = json.read_survey(spark, json.find_survey(spark, folder))
    out = json.survey_edges(doc).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))
    own = json.survey_nodes(doc).select("id", "name", "path", F.col("supply_chain_tier").alias("tier"))
    return own.join(out, "id", "left").select("id", "name", "path", "tier", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


@query("sqlite_graph", "S4", "S6", "K7", sql="SELECT concat('region:', n_regionkey) AS src, concat('nation:', n_nationkey) AS dst, n_nationkey + 100 AS line FROM nation")
def sqlite_graph(spark, d):
    """Edges upserted into a SQLite file for each region, some of them twice, and read from all files."""
    nation = load(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.concat(F.lit("region:"), "n_regionkey").alias("src"), F.concat(F.lit("nation:"), "n_nationkey").alias("dst"), (F.col("n_nationkey") + 100).alias("line"))
    stale = nation.where("line % 2 = 0").withColumn("line", F.lit(-1))
    folder = _folder(spark, "graphs")
    closure.cut(sqlite.write_sqlite(nation.union(stale), "region", "edges", folder, "src, dst"))
    return sqlite.read_sqlite(spark, folder, "SELECT src, dst, line FROM edges", "src string, dst string, line int")


_SOURCE = [
    "import os", "", "class C{k}(Base):", "    x = {k}", "    @wraps(f)", "    def m(self):", "        if self.x:", "            y = 1", "            return y", "        return {k}", "", "try:", "    def f():", "        return {k}",
    "except ValueError:", "    pass", "def f():", "    return 2",
]


def _sources(spark, d, text: str) -> DataFrame:
    k = F.col("s_suppkey")
    filled = F.replace(F.lit(text), F.lit("{k}"), k.cast("string"))
    return load(spark, d, "supplier").select(F.concat(F.lit("src/"), k, F.lit(".py")).alias("path"), filled.alias("text"), k.alias("k"))


@query("source_blocks", "P22", "P25", sql="""
WITH b(name, first_line, last_line, header_line, import_time, statements) AS (VALUES ('<module>', 1, 18, 1, true, 4), ('C', 4, 10, 3, true, 1), ('C.m', 7, 10, 5, false, 4), ('f', 14, 14, 13, false, 1), ('f#2', 18, 18, 17, false, 1))
SELECT concat('src/', s_suppkey, '.py') AS path, CASE WHEN name LIKE 'C%' THEN replace(name, 'C', concat('C', s_suppkey)) ELSE name END AS name, first_line::INT AS first_line, last_line::INT AS last_line, header_line::INT AS header_line, import_time, statements::INT AS statements,
  CASE name WHEN 'f' THEN s_suppkey % 2 = 0 WHEN 'C' THEN s_suppkey % 3 = 0 ELSE false END AS changed FROM supplier, b""")
def source_blocks(spark, d):
    """Blocks of each file, and whether a later version, with lines above and comments, changes their shape."""
    text = "\n".join(_SOURCE)
    before = _sources(spark, d, text)
    later = F.concat(F.lit("# a comment\n\n"), F.when(F.col("k") % 2 == 0, F.regexp_replace("text", r"(?m)^        return (\d+)$(?=\nexcept)", "        return -$1")).otherwise(F.col("text")))
    after = before.withColumn("text", F.when(F.col("k") % 3 == 0, F.regexp_replace(later, r"(?m)^    x = (\d+)$", "    x = [$1]  # why")).otherwise(later))
    old, new = blocks.source_blocks(before), blocks.source_blocks(after).select("path", "name", F.col("digest").alias("now"))
    return old.join(new, ["path", "name"]).select("path", "name", "first_line", "last_line", "header_line", "import_time", "statements", (F.col("digest") != F.col("now")).alias("changed"))


@query("statement_ordinals", "P24", sql="""
WITH o(line, block, ordinal) AS (VALUES (1, '<module>', 0), (12, '<module>', 1), (15, '<module>', 2), (16, '<module>', 3), (4, 'C', 0), (7, 'C.m', 0), (8, 'C.m', 1), (9, 'C.m', 2), (10, 'C.m', 3), (14, 'f', 0), (18, 'f#2', 0))
SELECT concat('src/', s_suppkey, '.py') AS path, line::INT AS line, CASE WHEN block LIKE 'C%' THEN replace(block, 'C', concat('C', s_suppkey)) ELSE block END AS block, ordinal::INT AS ordinal FROM supplier, o""")
def statement_ordinals(spark, d):
    return blocks.statement_owners(_sources(spark, d, "\n".join(_SOURCE)))


@query("package_entries", "J33", sql="""
SELECT concat('packages/p', s_suppkey) AS root, concat('packages/p', s_suppkey, '/', CASE s_suppkey % 6 WHEN 0 THEN 'lib/a.mjs' WHEN 1 THEN 'lib/b.ts' WHEN 2 THEN 'main/index.tsx' WHEN 3 THEN 'index.js' WHEN 4 THEN 'src/index.ts' ELSE 'lib/c.js' END) AS entry FROM supplier""")
def package_entries(spark, d):
    k = F.col("s_suppkey")
    root = F.concat(F.lit("packages/p"), k).alias("root")
    manifest = F.element_at(F.array(*map(F.lit, (
        '{"exports": {".": {"types": "./t.d.ts", "require": "./lib/r.js", "import": "./lib/a.mjs"}}, "main": "main"}', '{"exports": "./lib/b.js", "main": "main"}', '{"main": "./main"}', '{"name": "x"}',
        '{"main": "dist/none.js"}', '{"exports": {"default": "./lib/c.js"}, "module": "main"}',
    ))), (1 + k % 6).cast("int"))
    s = load(spark, d, "supplier")
    inside = F.when(k % 6 == 0, "lib/a.mjs,lib/r.js,main.js").when(k % 6 == 1, "lib/b.ts,main.js").when(k % 6 == 2, "main/index.tsx,index.js").when(k % 6 == 3, "index.js,index.ts,src/index.js").when(k % 6 == 4, "src/index.ts,dist/other.js").otherwise("lib/c.js,main.js")
    files = s.select(F.explode(F.split(inside, ",")).alias("f"), root).select(F.concat_ws("/", "root", "f").alias("path"))
    return joins.package_entries(s.select(root, manifest.alias("manifest")), files)


@query("csv_and_json_logs", "K4", "K6", "S10", sql="SELECT event_type AS kind, count(*) AS n, count(*) * 2 AS appended FROM events GROUP BY 1")
def csv_and_json_logs(spark, d):
    """Counts of what a CSV file and a JSON-lines log that was appended to twice give back."""
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("kind"))
    csv, log = _folder(spark, "csv"), _folder(spark, "log")
    graphs.write_csv(e, csv)
    logs.append_json_lines(e, log)
    logs.append_json_lines(e, log)
    one = spark.read.option("header", True).schema("event_id long, kind string").csv(csv).groupBy("kind").agg(F.count("*").alias("n"))
    return one.join(logs.read_json_lines(spark, log, "event_id long, kind string").groupBy("kind").agg(F.count("*").alias("appended")), "kind")
