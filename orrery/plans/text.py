"""Queries of names, paths, text functions and document statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import names, text
from orrery.operators import corpus
from orrery.sources.tables import load, nodes, ops

from .register import query, with_

#: An invented overview that the BM25 query searches for: words of the generated languages.
PROBE = "the and that erthe hein for with there and the und der die les des"


@query("tokens", "X1", "X2", sql=r"""
SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))::INT AS tokens, len(regexp_extract_all(lower(text), '\p{L}{2,}'))::INT AS words FROM documents""")
def tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("tokens"), F.size(text.letter_words(F.col("text"))).alias("words"))


@query("identifier_tokens", "X3", "P21", sql=r"""
SELECT p_partkey, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(concat(p_brand, p_type, '_', p_name), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: x <> '') AS tokens FROM part""")
def identifier_tokens(spark, d):
    return load(spark, d, "part").select("p_partkey", text.identifier_tokens(F.concat("p_brand", "p_type", F.lit("_"), "p_name")).alias("tokens"))


@query("path_patterns", "X4", sql=with_("nodes") + r"""
, p AS (SELECT CASE WHEN line % 7 = 0 THEN replace(path, '.go', '.min.js') WHEN line % 7 = 1 THEN replace(path, '.go', '.bundle.css') ELSE path END AS path FROM nodes)
SELECT CASE WHEN regexp_matches(path, '\.min\.[^/]*$') THEN '*.min.' || string_split(path, '.')[-1] WHEN regexp_matches(path, '\.bundle\.[^/]*$') THEN '*.bundle.' || string_split(path, '.')[-1] ELSE string_split(path, '/')[1] || '/' END AS pattern, count(*) AS n FROM p GROUP BY 1""")
def path_patterns(spark, d):
    shaped = F.when(F.col("line") % 7 == 0, F.replace("path", F.lit(".go"), F.lit(".min.js"))).when(F.col("line") % 7 == 1, F.replace("path", F.lit(".go"), F.lit(".bundle.css"))).otherwise(F.col("path"))
    return nodes(spark, d).groupBy(text.path_pattern(shaped).alias("pattern")).agg(F.count("*").alias("n"))


@query("utc_days", "X5", sql=with_("ops") + "SELECT ts::DATE AS day, count(*) AS n FROM ops GROUP BY 1")
def utc_days(spark, d):
    return ops(spark, d).groupBy(text.utc_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("day")).agg(F.count("*").alias("n"))


#: Words by their own borders, since engines differ on \\b.
_ITEM, _REFERENCE = r"[A-Z][a-z]+-[0-9]+", r"(?<![\p{L}\p{N}_])[Tt]h[a-z]{2}(?![\p{L}\p{N}_])"


@query("masked_text", "P15", sql=r"""
WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[A-Z][a-z]+-[0-9]+', 'ITEM', 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS words FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(words, lambda w: CASE WHEN regexp_full_match(w, '[Tt]h[a-z]{2}') THEN 'REF' ELSE w END), '')) AS digest FROM t""")
def masked_text(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.mask(F.col("text"), _ITEM, _REFERENCE).cast("binary")).alias("digest"))


@query("item_mentions", "X15", sql=r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS word, unnest(range(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')))) AS k FROM documents),
p AS (SELECT *, (sum(length(word)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS stop FROM t)
SELECT doc_id, word AS item, stop - length(word) AS begin, stop AS "end" FROM p WHERE regexp_full_match(word, '[Tt]h[a-z]{2}') AND NOT (stop > 40 AND stop - length(word) < 90)""")
def item_mentions(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return text.find_items(docs, _REFERENCE, F.array(F.struct(F.lit(40).alias("begin"), F.lit(90).alias("end"))))


@query("token_estimates", "L1", "L2", "K10", "L4", sql="""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END::BIGINT AS tokens, (length(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})) // 4)::BIGINT AS json_tokens, CASE doc_id % 3 WHEN 0 THEN 4000 WHEN 1 THEN 1500 ELSE 64000 END::BIGINT AS budget FROM documents""")
def token_estimates(spark, d):
    spec = F.when(F.col("doc_id") % 3 == 0, "4k").when(F.col("doc_id") % 3 == 1, " 1.5K").otherwise("64000")
    return load(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.estimate_json_tokens(F.struct("doc_id", "lang", "source")).alias("json_tokens"), text.tier_spec(spec).alias("budget"))


@query("truncated_text", "L3", sql=r"""
WITH t AS (SELECT doc_id, replace(text, '. ', e'.\n\n') AS text FROM documents), c AS (SELECT *, substr(text, 1, 800) AS head, regexp_extract(substr(text, 1, 800), '(?s)^(.+)\n\n', 1) AS cut FROM t)
SELECT doc_id, length(CASE WHEN length(text) <= 800 THEN text WHEN cut <> '' THEN cut ELSE head END)::INT AS n, md5(CASE WHEN length(text) <= 800 THEN text WHEN cut <> '' THEN cut ELSE head END) AS digest FROM c""")
def truncated_text(spark, d):
    out = text.truncate_at(F.replace("text", F.lit(". "), F.lit(".\n\n")), 200)
    return load(spark, d, "documents").select("doc_id", F.length(out).alias("n"), F.md5(out.cast("binary")).alias("digest"))


_SQL = "concat('select a, b FROM ', replace(p_name, ' ', '_'), CASE WHEN p_size % 2 = 0 THEN concat(' JOIN ', p_type, ' ON x') ELSE '' END, CASE WHEN p_size % 5 = 0 THEN ' where y in (SELECT z from where_t)' ELSE '' END)"


@query("sql_statements", "X9", "X10", sql=rf"""
WITH q AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN concat('insert into Log SELECT * FROM ', p_type) ELSE {_SQL} END AS q FROM part)
SELECT p_partkey, list_filter(list_transform(regexp_extract_all(q, '(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+[`"]?(\w+)', 1), lambda x: lower(x)), lambda x: x NOT IN ('select', 'set', 'values', 'where', 'and', 'or')) AS tables,
       CASE WHEN q LIKE 'insert%' THEN 'INSERT' ELSE 'SELECT' END AS kind FROM q""")
def sql_statements(spark, d):
    q = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("insert into Log SELECT * FROM "), "p_type")).otherwise(F.expr(_SQL))
    return load(spark, d, "part").select("p_partkey", text.sql_tables(q).alias("tables"), text.sql_kind(q).alias("kind"))


@query("digests", "X11", "P20", sql="""
SELECT n_regionkey, CASE WHEN count(*) = 1 THEN min(n_name) ELSE concat('module-set-', substr(sha256(string_agg(n_name, ',' ORDER BY n_name)), 1, 16)) END AS module FROM nation GROUP BY 1""")
def digests(spark, d):
    names_ = F.sort_array(F.collect_list("n_name"))
    g = load(spark, d, "nation").groupBy("n_regionkey").agg(names_.alias("m"))
    return g.select("n_regionkey", F.when(F.size("m") == 1, F.col("m")[0]).otherwise(F.concat(F.lit("module-set-"), text.digest16(F.array_join("m", ",")))).alias("module"))


@query("fingerprint", "X12", "S23", sql="SELECT source, sha256('head' || string_agg(concat(lpad(doc_id::VARCHAR, 12, '0'), ':', sha256(text)), ',' ORDER BY lpad(doc_id::VARCHAR, 12, '0'))) AS digest FROM documents GROUP BY source")
def fingerprint(spark, d):
    line = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(":"), F.sha2("text", 256))
    return load(spark, d, "documents").groupBy("source").agg(F.sha2(F.concat(F.lit("head"), F.array_join(F.sort_array(F.collect_list(line)), ",")), 256).alias("digest"))


@query("prose_lists", "X18", sql="SELECT conv_id, count(*) FILTER (contains(text, ' ')) * 2 >= count(*) AS prose FROM conversations GROUP BY 1")
def prose_lists(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(text.is_prose(F.col("text")).alias("prose"))


@query("plain_prose", "X19", sql="SELECT n_nationkey, concat(n_name, ' code link ', n_nationkey) AS line FROM nation")
def plain_prose(spark, d):
    raw = F.concat(F.lit("> [!NOTE] **"), "n_name", F.lit("** `code` [link](http://x) ![i](y)"), F.col("n_nationkey").cast("string"))
    return load(spark, d, "nation").select("n_nationkey", text.plain_inline(raw).alias("line"))


@query("secret_scan", "X16", sql=r"""
SELECT doc_id, 'key_assignment' AS rule, unnest(regexp_extract_all(text, '(?i)\b(?:TOKEN|SECRET|PASSWORD|API_KEY)\s*=\s*"([0-9A-Za-z_\-]{12,})"', 1)) AS secret FROM documents
UNION ALL SELECT doc_id, 'aws_key', unnest(regexp_extract_all(text, '\b(AKIA[0-9A-Z]{16})\b', 1)) FROM documents UNION ALL SELECT doc_id, 'private_key', unnest(regexp_extract_all(text, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1)) FROM documents""")
def secret_scan(spark, d):
    return load(spark, d, "documents").select("doc_id", F.inline(text.secrets(F.col("text"))))


@query("include_directives", "S24", sql="""
SELECT p_partkey, pos - 1 AS pos, substr(target, 2, length(target) - 2) AS header, target LIKE '"%' AS quoted FROM (
  SELECT p_partkey, unnest(range(1, 3)) AS pos, unnest([concat('<', p_type, '.h>'), concat('"', p_brand, '.h"')]) AS target FROM part)""")
def include_directives(spark, d):
    src = F.concat(F.lit("#include <"), "p_type", F.lit('.h>\nint x;\n# include "'), "p_brand", F.lit('.h"\n'))
    out = load(spark, d, "part").select("p_partkey", F.posexplode(text.includes(src)).alias("pos", "t"))
    return out.select("p_partkey", F.col("pos").cast("long").alias("pos"), F.substring("t", F.lit(2), F.length("t") - 2).alias("header"), F.col("t").startswith('"').alias("quoted"))


@query("numbits", "S7", "S6", sql="SELECT l_linenumber, list_sort(list(DISTINCT l_suppkey % 40))::INT[] AS lines FROM lineitem GROUP BY 1")
def numbits(spark, d):
    bits = F.bit_or(F.expr("shiftleft(1L, cast(l_suppkey % 40 as int))"))
    blob = F.reverse(F.split(F.regexp_replace(F.lpad(F.hex(F.col("b")), 10, "0"), "(..)", "$1,"), ","))
    g = load(spark, d, "lineitem").groupBy("l_linenumber").agg(bits.alias("b"))
    return g.select("l_linenumber", text.numbits(F.unhex(F.array_join(blob, ""))).alias("lines"))


# --- names


@query("member_names", "P10", "P12", sql=r"""
WITH n AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat(p_brand, '.', p_type, '.run') WHEN 1 THEN concat(p_type, '::', 'go') ELSE p_type END AS name FROM (SELECT * REPLACE (replace(p_brand, '#', '_') AS p_brand) FROM part))
SELECT p_partkey, CASE WHEN name LIKE '%.run' THEN replace(name, '.run', '') WHEN name LIKE '%::go' THEN replace(name, '::go', '') END AS owner, CASE WHEN name LIKE '%.run' THEN 'run' WHEN name LIKE '%::go' THEN 'go' ELSE name END AS short, name AS base FROM n""")
def member_names(spark, d):
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    name = F.when(F.col("p_size") % 3 == 0, F.concat(brand, F.lit("."), "p_type", F.lit(".run"))).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("::go"))).otherwise(F.col("p_type"))
    return load(spark, d, "part").select("p_partkey", names.owner(name).alias("owner"), names.short_name(name).alias("short"), names.base_type(F.concat(name, F.lit(" <T>"))).alias("base"))


@query("generics", "P11", "P13", sql="SELECT p_partkey, concat(p_type, '.get') AS plain, list_sort(list_distinct([p_type, 'str'])) AS bases FROM part")
def generics(spark, d):
    name = F.concat("p_type", F.lit("<Map<K,List<"), "p_name", F.lit(">>>.get<T>"))
    return load(spark, d, "part").select("p_partkey", names.strip_generics(name).alias("plain"), names.annotation_bases(F.concat(F.lit("Optional[Union["), "p_type", F.lit(", str]] | None"))).alias("bases"))


@query("route_paths", "P18", "F11", "F8", "F9", sql="""
SELECT o_orderkey, concat('/orders/:id/', o_orderstatus, '/:who') AS route, o_orderstatus IN ('O', 'P') OR o_orderpriority = '1-URGENT' AS matches, o_orderstatus = 'F' AS at_end FROM orders""")
def route_paths(spark, d):
    raw = F.concat(F.lit("/orders/{id}/"), "o_orderstatus", F.lit("/<str:who>"))
    method = F.when(F.col("o_orderpriority") == "1-URGENT", "any").when(F.col("o_orderstatus") == "O", "GET, post").when(F.col("o_orderstatus") == "F", "PUT")
    at_end = names.path_ends_with(F.concat(F.lit("a/b/"), "o_orderstatus"), F.when(F.col("o_orderstatus") == "F", "b/F").otherwise("xb/O"))
    return load(spark, d, "orders").select("o_orderkey", names.normalize_route(raw).alias("route"), names.method_matches(method, F.lit("post ")).alias("matches"), at_end.alias("at_end"))


@query("route_extraction", "P7", "P8", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '/marker' ELSE '/concept' END AS path, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN NULL ELSE 'GET' END AS method,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'websocket' WHEN '2-HIGH' THEN 'grpc' ELSE 'http' END AS protocol, CASE o_orderpriority WHEN '1-URGENT' THEN 'WS' WHEN '2-HIGH' THEN 'RPC' ELSE 'GET' END AS token FROM orders WHERE o_orderstatus <> 'P'""")
def route_extraction(spark, d):
    from orrery.functions import routes

    raw = names.lookup(F.col("o_orderpriority"), {"1-URGENT": "WS", "2-HIGH": "RPC"}, "GET")
    meta = F.struct(F.when(F.col("o_orderstatus") == "F", "route").alias("framework_role"), F.lit("/marker").alias("route_path"), raw.alias("http_method"), F.lit(None).cast("string").alias("route_protocol"))
    concept = F.when(F.col("o_orderstatus") != "P", F.struct(F.lit("/concept").alias("path"), raw.alias("method")))
    return load(spark, d, "orders").select("o_orderkey", routes.route_of(meta, concept).alias("r")).where("r is not null").select("o_orderkey", "r.*").withColumn("token", routes.method_token(F.col("protocol"), F.col("method")))


@query("package_roots", "P19", sql="SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) END AS root FROM part")
def package_roots(spark, d):
    t = F.lower("p_type")
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("rust:"), t, F.lit("::Serialize:0-0:module:module"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("python:"), t, F.lit(".adapters:0-0:module:module"))).otherwise(F.concat(F.lit("go:"), t))
    return load(spark, d, "part").select("p_partkey", names.root_package(path).alias("root"))


@query("visibility", "P9", sql="""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 2 THEN 'private' ELSE 'public' END AS level, CASE p_size % 4 WHEN 0 THEN 'language_modifier' WHEN 1 THEN 'language_modifier' WHEN 2 THEN 'name_convention' ELSE 'default' END AS signal FROM part""")
def visibility(spark, d):
    k = F.col("p_size") % 4
    modifiers = F.when(k == 0, F.array(F.lit("static"), F.lit("unexported"), F.lit("public"))).otherwise(F.array().cast("array<string>"))
    name = F.when(k == 2, F.concat("p_type", F.lit("._hidden"))).otherwise(F.concat("p_type", F.lit(".__init__")))
    v = names.visibility(modifiers, name, F.lit("python"), F.when(k == 1, "global"))
    return load(spark, d, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.level", "v.signal")


@query("url_templates", "P16", "E3", sql="""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('/v1/', lower(p_type), '/{id}') WHEN 1 THEN '/items/{id}' WHEN 2 THEN '/items' ELSE '{host}' END AS url,
       CASE p_size % 4 WHEN 0 THEN 'literal' WHEN 1 THEN 'literal' ELSE 'variable' END AS kind FROM part""")
def url_templates(spark, d):
    k = F.col("p_size") % 4
    t = F.when(k == 0, F.lit("/${ver}/${type}/${id}")).when(k == 1, F.lit("${host}/items/${id}")).when(k == 2, F.lit("/items${query}")).otherwise(F.lit("${base}"))
    consts = F.create_map(F.lit("ver"), F.lit("v1"), F.lit("type"), F.lower("p_type"), F.lit("base"), F.lit("{host}"))
    r = names.fold_template(t, consts)
    out = load(spark, d, "part").select("p_partkey", "p_size", r.alias("r"))
    return out.select("p_partkey", F.when(F.col("p_size") % 4 == 3, F.lit("{host}")).otherwise(F.col("r.url")).alias("url"), "r.kind")


@query("url_joins", "P17", sql="SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN concat('/', lower(p_type), '/{id}') END AS url FROM part")
def url_joins(spark, d):
    item = lambda v, lit: F.struct(v.alias("value"), F.lit(lit).alias("literal"))
    items = F.when(F.col("p_size") % 5 > 0, F.array(item(F.lit("host"), False), item(F.lower("p_type"), True), item(F.lit("id"), False))).otherwise(F.array(item(F.lit("host"), False)))
    return load(spark, d, "part").select("p_partkey", names.fold_join(items, "/").alias("url"))


_PROCESS_FILES = (
    "docs/LICENSE-MIT.txt", "Change_Log.md", "security-model.md", "src/authors_list.py", "security.yaml", "authors.py", "COPYING.LESSER", "CODE OF CONDUCT", "code-of-conduct.rst", "NEWS", "docs/license-server-protocol.md",
    "licence_apache", "releaseNotes.md", "Release-Notes.adoc", "HISTORY.txt", "CONTRIBUTING.md", "thanksgiving.md", "changelog-", "CHANGELOG-2.x", "notice.json",
)


@query("process_files", "F12", "F16", sql=f"""
WITH p AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _PROCESS_FILES)}][1 + p_partkey % {len(_PROCESS_FILES)}] AS path FROM part),
n AS (SELECT *, lower(string_split(path, '/')[-1]) AS file FROM p),
s AS (SELECT *, replace(replace(replace(string_split(file, '.')[1], '-', ''), '_', ''), ' ', '') AS joined, string_split(file, '.')[1] AS name FROM n)
SELECT p_partkey, path, NOT regexp_matches(file, '[.](py|yaml|json)$') AND (joined IN ('contributing', 'codeofconduct', 'changelog', 'copying', 'news', 'releasenotes', 'history', 'notice') AND name NOT LIKE '%-' OR regexp_matches(name, '^(licen[sc]e|copying|changelog)[-_][a-z0-9+.]+$')) AS process,
       p_partkey % 2 = 0 AS mentions FROM s""")
def process_files(spark, d):
    k = F.col("p_partkey")
    path = F.element_at(F.array(*map(F.lit, _PROCESS_FILES)), (1 + k % len(_PROCESS_FILES)).cast("int"))
    mentions = F.concat(F.lit("import "), F.when(k % 2 == 0, "loader").otherwise("loaders")).rlike(r"\bloader\b")
    return load(spark, d, "part").select("p_partkey", path.alias("path"), names.is_process_file(path).alias("process"), mentions.alias("mentions"))


@query("arity_bounds", "X17", "F14", sql="""
SELECT p_partkey, p_size % 3 AS required, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size % 3 + 1 END AS maximum, 2 >= p_size % 3 AND (p_size % 2 = 0 OR 2 <= p_size % 3 + 1) AS admits FROM part""")
def arity_bounds(spark, d):
    e = lambda n, v, h: F.struct(F.lit(n).alias("name"), F.lit(v).alias("variadic"), F.lit(h).alias("has_default"))
    entries = F.concat(F.array_repeat(e("a", False, False), F.col("p_size") % 3), F.array(e("b", False, True)), F.when(F.col("p_size") % 2 == 0, F.array(e("*rest", False, False))).otherwise(F.array().cast("array<struct<name:string,variadic:boolean,has_default:boolean>>")))
    out = load(spark, d, "part").select("p_partkey", names.arity(entries).alias("x")).select("p_partkey", "x.*")
    return out.withColumn("admits", names.admits(F.col("required"), F.col("maximum"), F.lit(2)))


# --- documents


@query("document_frequency", "A16", sql=r"""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), c AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT term, df, round(ln((1.0 + n) / (1 + df)) + 1, 6) AS idf FROM c, n WHERE df >= 2 AND df <= 0.8 * n""")
def document_frequency(spark, d):
    docs = load(spark, d, "documents")
    out = corpus.idf(corpus.term_counts(docs, "doc_id", text.tokens(F.col("text"))), docs.count())
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_weights", "A16", sql=r"""
WITH t AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM conversations), n AS (SELECT count(*) AS n FROM conversations), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), i AS (SELECT term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM f, n WHERE df >= 2 AND df <= 0.8 * n), w AS (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM c JOIN i USING (term))
SELECT id, count(*) AS terms, round(sum(x), 4) AS total FROM (SELECT id, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS x FROM w) GROUP BY id""")
def tfidf_weights(spark, d):
    docs = load(spark, d, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    counts = corpus.term_counts(docs, "id", text.tokens(F.col("text")))
    w = corpus.tfidf(counts, corpus.idf(counts, docs.count()))
    return w.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 4).alias("total"))


@query("overview_rank", "W5", "W6", sql=rf"""
WITH h AS (SELECT doc_id AS id, source, regexp_extract_all(lower(substr(text, 1, 4000)), '\p{{L}}{{2,}}') AS words FROM documents), l AS (SELECT id, len(words) AS length FROM h), a AS (SELECT count(*) AS n, avg(length) AS average FROM l),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split('{PROBE}', ' ')) AS term) GROUP BY 1), c AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM h) GROUP BY ALL), m AS (SELECT * FROM c JOIN q USING (term)),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM m, a GROUP BY term, n), s AS (SELECT id, sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score FROM m JOIN f USING (term) JOIN l USING (id), a GROUP BY id)
SELECT h.id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(coalesce(score, 0), 6) DESC, h.id) AS place FROM h LEFT JOIN s USING (id)""")
def overview_rank(spark, d):
    from pyspark.sql import Window

    words = text.letter_words(F.substring("text", 1, 4000))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", words.alias("words")).withColumn("length", F.size("words"))
    n, average = docs.agg(F.count("*"), F.avg("length")).first()
    probe = F.explode(F.split(F.lit(PROBE), " "))
    q = spark.range(1).select(probe.alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    counts = docs.select("id", "length", F.explode("words").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    scored = docs.select("id", "source").join(corpus.bm25(counts, q, n, average or 1.0), "id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return scored.select("id", "score", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id")).cast("long").alias("place"))
