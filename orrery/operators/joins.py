"""Candidate, interval, prefix, name and comparison joins.

Each join has an equality key, so that it shuffles by hash and never compares all pairs: intervals are cut into bins of
lines, suffixes and prefixes are exploded into their components. Choices among candidates are aggregates (min_by, max_by),
which combine before the shuffle, not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bin of the interval joins.
BIN = 64


def narrowest(places: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, start, end, first, second): the two narrowest spans (container, path, start, end) around each place (path, start, end).

    first and second are struct(length, container, s), s being the span's start; ties go to the smaller container, and second is
    there for a place that must not get itself. Spans are laid into bins of BIN lines, so a place meets only the spans of its own
    bin. Equal places are asked once, and of equal spans two are kept, so that what meets grows with the lines of a file and not
    with the square of what lies on them.
    """

    def two(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rank <= 2")

    some = two(spans.select("path", F.col("start").alias("s"), F.col("end").alias("e"), "container"), ["path", "s", "e"], "container").drop("rank")
    binned = some.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / BIN), F.floor(F.col("e") / BIN))))
    asked = places.select("path", "start", "end").distinct().withColumn("bin", F.floor(F.col("start") / BIN))
    inside = asked.join(binned, ["path", "bin"]).where((F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")))
    near = two(inside.select("path", "start", "end", F.struct((F.col("e") - F.col("s")).alias("length"), "container", "s").alias("x")), ["path", "start", "end"], "x")
    return near.groupBy("path", "start", "end").agg(F.max(F.when(F.col("rank") == 1, F.col("x"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("x"))).alias("second"))


def innermost(places: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, x): for each place (id, path, start, end) its narrowest span (container, path, start, end) other than itself, x as in ``narrowest``."""
    other = F.when(F.col("first.container") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    found = places.select("id", "path", "start", "end").join(narrowest(places, spans), ["path", "start", "end"])
    return found.select("id", other.alias("x")).where("x is not null").groupBy("id").agg(F.min("x").alias("x"))


def innermost_container(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, container): for each point (id, path, line) the narrowest span (container, path, start, end) around it; ties go to the smaller id."""
    return innermost(points.select("id", "path", F.col("line").alias("start"), F.col("line").alias("end")), spans).select("id", "x.container")


def containment_by_name(children: DataFrame, containers: DataFrame) -> DataFrame:
    """(id, container): of the containers named like the child's parent, the only one, else one of its file, else of its language.

    children: id, parent, path, language; containers: container, name, path, language. Names without a fitting one give no row.
    """
    c = containers.withColumn("n", F.count("*").over(Window.partitionBy("name"))).withColumnsRenamed({"path": "cpath", "language": "clanguage"})
    j = children.join(c, children["parent"] == c["name"])
    rank = F.when(F.col("n") == 1, 0).when(F.col("path") == F.col("cpath"), 1).when(F.col("language") == F.col("clanguage"), 2)
    return j.withColumn("rank", rank).where("rank is not null").groupBy("id").agg(F.min_by("container", F.struct("rank", "container")).alias("container"))


def consecutive(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """(group, src, dst): each row and its successor."""
    return rows.withColumn("dst", F.lead("id").over(Window.partitionBy(group).orderBy(*order))).where("dst is not null").select(group, F.col("id").alias("src"), "dst")


def recover_calls(calls: DataFrame, hints: DataFrame, methods: DataFrame, known: DataFrame, text=lambda c: c) -> DataFrame:
    """(src, dst, line, confidence, fallback): unresolved calls tied to a method of a class that their caller mentions.

    calls: src, name, line, confidence; hints: src, class, line, confidence; methods: class, name, method; known: src, dst.
    The hint nearest in line wins, then the smaller class, as ``text`` writes it; more than one candidate halves the confidence to 0.5 at most.
    """
    h = hints.select(F.col("src"), F.col("class"), F.col("line").alias("hline"), F.col("confidence").alias("hconf"))
    j = calls.join(h, "src").join(methods, ["class", "name"])
    best = F.min_by(F.struct("method", "hconf"), F.struct(F.abs(F.col("line") - F.col("hline")), text(F.col("class")))).alias("best")
    g = j.groupBy("src", "name", "line").agg(best, F.count("*").alias("n"), F.min("confidence").alias("confidence"))
    base = F.least("confidence", "best.hconf")
    out = g.select("src", F.col("best.method").alias("dst"), "line", F.when(F.col("n") > 1, F.least(base, F.lit(0.5))).otherwise(base).alias("confidence"), (F.col("n") > 1).alias("fallback"))
    out = out.join(known, ["src", "dst"], "left_anti")
    return out.groupBy("src", "dst").agg(F.min(F.struct("line", "confidence", "fallback")).alias("x")).select("src", "dst", "x.*")


def unique_dispatch(calls: DataFrame, methods: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(src, dst) of calls whose keys name exactly one method; calls that are known already stay out."""
    one = methods.groupBy(*keys).agg(F.min("method").alias("dst"), F.max("method").alias("last")).where("dst = last")
    return calls.join(one, keys).select("src", "dst").distinct().join(known, ["src", "dst"], "left_anti")


def nearest_manifest(imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(id, name, manifest, ambiguous): the manifest that declares ``name`` and lies nearest above the importing path.

    imports: id, path, name; manifests: manifest, dir, name, scope_rank. One declaration of a manifest folder counts, the
    nearest to a runtime one. Folders above a path are exploded and joined by equality, the longest wins; where none
    encloses it, the smallest id is taken and marked, if there is more than one.
    """
    one = manifests.groupBy("dir", "name").agg(F.min_by("manifest", F.struct("scope_rank", "manifest")).alias("manifest"))
    every = one.groupBy("name").agg(F.min("manifest").alias("first"), F.count("*").alias("n"))
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    near = imports.select("id", "name", F.posexplode(above).alias("depth", "dir")).join(one, ["dir", "name"]).groupBy("id", "name").agg(F.max_by("manifest", "depth").alias("near"))
    j = imports.select("id", "name").join(every, "name").join(near, ["id", "name"], "left")
    return j.select("id", "name", F.coalesce("near", "first").alias("manifest"), (F.col("near").isNull() & (F.col("n") > 1)).alias("ambiguous"))


def pair_by_name(senders: DataFrame, receivers: DataFrame) -> DataFrame:
    """(sender, receiver, kind): pairs of one scope with equal values, or equal identifiers where not both values are known.

    senders: sender, scope, value, identifier, literal; receivers alike. kind: literal, constant, variable or unresolved.
    """
    s = senders.toDF("sender", "scope", "v1", "i1", "l1")
    r = receivers.toDF("receiver", "scope", "v2", "i2", "l2")
    by_value = s.where("v1 is not null").join(r.where("v2 is not null"), (s["scope"] == r["scope"]) & (F.col("v1") == F.col("v2")))
    by_value = by_value.select("sender", "receiver", F.when(F.col("l1") & F.col("l2"), "literal").otherwise("constant").alias("kind"))
    by_id = s.where("i1 is not null").join(r.where("i2 is not null"), (s["scope"] == r["scope"]) & (F.col("i1") == F.col("i2"))).where("v1 is null or v2 is null")
    by_id = by_id.select("sender", "receiver", F.when(F.col("v1").isNull() & F.col("v2").isNull(), "variable").otherwise("unresolved").alias("kind"))
    return by_value.unionByName(by_id)


def link_tables(mentions: DataFrame, tables: DataFrame) -> DataFrame:
    """(query_id, table_id, confidence, fallback): mentions (query_id, name) of tables (table_id, name) whatever the case."""
    t = tables.groupBy(F.lower("name").alias("key")).agg(F.min("table_id").alias("table_id"), F.count("*").alias("n"))
    j = mentions.withColumn("key", F.lower("name")).join(t, "key")
    return j.select("query_id", "table_id", F.when(F.col("n") > 1, 0.5).otherwise(0.85).alias("confidence"), (F.col("n") > 1).alias("fallback"))


def link_operations(operations: DataFrame, routes: DataFrame, matches: Column) -> DataFrame:
    """(operation, route, confidence): by path and method at 0.85, all of them; by name at 0.9 where no path fits.

    operations: operation, path, method; routes: route, name, rpath, rmethod. Paths are compared in a shape without
    parameter names, an equality key; ``matches`` decides on the methods.
    """
    shape = lambda c: F.regexp_replace(c, r":[A-Za-z_]+", ":")
    a, b = operations.withColumn("shape", shape(F.col("path"))), routes.withColumn("shape", shape(F.col("rpath")))
    by_path = a.join(b, "shape").where(matches).select("operation", "route", F.lit(0.85).alias("confidence"))
    rest = operations.join(by_path.select("operation").distinct(), "operation", "left_anti")
    by_name = rest.join(routes, rest["operation"] == routes["name"]).select("operation", "route", F.lit(0.9).alias("confidence"))
    return by_path.unionByName(by_name)


def compare_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): ids of either side only, or of both."""
    j = left.select("id").distinct().withColumn("l", F.lit(1)).join(right.select("id").distinct().withColumn("r", F.lit(1)), "id", "full_outer")
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return j.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def choose_overload(calls: DataFrame, candidates: DataFrame, admits: Column) -> DataFrame:
    """(call, chosen, confidence, ambiguous): of the first tier with candidates that admit the call, the first by place.

    calls: call, name, n_args; candidates: id, name, tier, required, maximum, path, line. One candidate is sure, n give
    1 / sqrt(n); none gives no choice and 0.
    """
    # Calls of one name and count have one answer: they are asked once, however many there are.
    asked = calls.select("name", "n_args").distinct()
    fits = asked.join(candidates, "name").where(admits)
    per_tier = fits.groupBy("name", "n_args", "tier").agg(F.min_by("id", F.struct("path", "line", "id")).alias("chosen"), F.count("*").alias("n"))
    first = per_tier.groupBy("name", "n_args").agg(F.min_by(F.struct("chosen", "n"), "tier").alias("x")).toDF("fname", "fargs", "x")
    out = calls.join(first, (F.col("name") == F.col("fname")) & F.col("n_args").eqNullSafe(F.col("fargs")), "left")
    return out.select("call", F.col("x.chosen").alias("chosen"), F.coalesce(F.round(1 / F.sqrt("x.n"), 6), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("x.n") > 1, F.lit(False)).alias("ambiguous"))


def by_name(names: DataFrame, symbols: DataFrame, preferred: str) -> DataFrame:
    """(name, id, fallback): the symbol of each name, of the ``preferred`` kind if there is one; more than one is a fallback."""
    g = names.select("name").distinct().join(symbols, "name").groupBy("name")
    return g.agg(F.min_by("id", F.struct((F.col("kind") != preferred).cast("int"), "id")).alias("id"), (F.count("*") > 1).alias("fallback"))


def suffix_matches(changed: DataFrame, paths: DataFrame) -> DataFrame:
    """(changed, path): equal paths; for changed files without one, paths of which either ends with the other.

    Suffixes at component borders are exploded on both sides, so the join is by equality.
    """
    exact = changed.join(paths, F.col("changed") == F.col("path")).select("changed", "path")
    rest = changed.join(exact.select("changed").distinct(), "changed", "left_anti")
    tails = lambda c: F.transform(F.sequence(F.lit(0), F.size(F.split(c, "/")) - 1), lambda k: F.array_join(F.slice(F.split(c, "/"), k + 1, 1_000), "/"))
    a = rest.select("changed", F.explode(tails(F.col("changed"))).alias("tail")).join(paths, F.col("tail") == F.col("path")).select("changed", "path")
    b = paths.select("path", F.explode(tails(F.col("path"))).alias("tail")).join(rest, F.col("tail") == F.col("changed")).select("changed", "path")
    return exact.unionByName(a).unionByName(b).distinct()


def first_hint(symbols: DataFrame, hints: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(id, key): the first of a symbol's ordered hints that the catalogue has. hints: id, hint array; catalogue: key."""
    h = symbols.select("id").join(hints, "id").select("id", F.posexplode("hint").alias("pos", "key"))
    return h.join(catalogue, "key").groupBy("id").agg(F.min_by("key", "pos").alias("key"))


def unify_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with every file symbol (id, path) replaced by the one symbol of its path, the smallest id."""
    keep = files.groupBy("path").agg(F.min("id").alias("keep"))
    swap = files.join(keep, "path").where("id <> keep").select("id", "keep")
    j = edges.join(swap.toDF("src", "s"), "src", "left").join(swap.toDF("dst", "t"), "dst", "left")
    return j.select(F.coalesce("s", "src").alias("src"), F.coalesce("t", "dst").alias("dst"), "type")


def precedence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: catalogues overlaid by tier."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, module, path): each dotted import at its longest prefix that is a file; beside the importer where none is.

    imports: id, folder, module; files: path. Prefixes are exploded and joined by equality.
    """
    dotted = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(dotted)), lambda k: F.concat(F.array_join(F.slice(dotted, 1, k), "/"), F.lit(".py")))
    whole = imports.select("id", "folder", "module", F.posexplode(prefixes).alias("k", "path"))
    near = whole.select("id", "folder", "module", (F.col("k") - 1000).alias("k"), F.concat_ws("/", "folder", "path").alias("path"))
    return whole.unionByName(near).join(files.select("path").distinct(), "path").groupBy("id", "module").agg(F.max_by("path", "k").alias("path"))


#: Shares into which the classes of one scope and one set of bases are dealt.
SHARES = 8


def dispatch(closure: DataFrame, classes: DataFrame, methods: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, framework): classes to the methods of their scope that a framework calls on them.

    closure: class, base (all ancestors); classes: class, scope, which a class has one of; methods: scope, name, method; rules:
    framework, base, method_name, a fixed table. Classes go by their set of bases of rules, and a method is found once for a scope
    and a set, so that the last join makes each result row once and nothing else. Its rows may be as many as the square of a scope.
    """
    ruled = closure.join(F.broadcast(rules.select("base").distinct()), "base", "left_semi").groupBy("class").agg(F.sort_array(F.collect_set("base")).alias("bases"))
    own = ruled.join(classes.distinct(), "class").withColumn("share", F.pmod(F.xxhash64("class"), F.lit(SHARES)))
    names = ruled.select("bases").distinct().withColumn("base", F.explode("bases")).join(F.broadcast(rules), "base").select("bases", "framework", F.col("method_name").alias("name")).distinct()
    called = methods.join(names, "name").select("scope", "bases", "method", "framework").distinct()
    called = called.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<bigint>")))
    parts, keys = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["scope", "bases", "share"]  # small before they meet, so that a size would call for few tasks
    return own.repartition(parts, *keys).join(called.repartition(parts, *keys), keys).select(F.col("class").alias("src"), F.col("method").alias("dst"), "framework")


def probe_paths(views: DataFrame, patterns: list[str], files: DataFrame) -> DataFrame:
    """(view, path): the first convention path, of ``patterns`` with {name}, that is a file."""
    tries = F.array(*[F.replace(F.lit(p), F.lit("{name}"), F.col("name")) for p in patterns])
    return views.select("view", F.posexplode(tries).alias("k", "path")).join(files.select("path").distinct(), "path").groupBy("view").agg(F.min_by("path", "k").alias("path"))


#: Endings that are tried for a file named without one, in this order.
PROBED = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".mts", ".vue", ".json")
BUILT_FROM = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


def package_entries(packages: DataFrame, files: DataFrame) -> DataFrame:
    """(root, entry): the file that a package (root, manifest as JSON) is entered by; ``files`` has a column path.

    What is declared comes first: exports, its entry for "." or conditions import, require and default in this order, then
    module and main; then index and src/index. Each is tried as it stands, with the endings, as the source of a built file,
    and as a folder's index. All tries are exploded with their places and joined by equality.
    """
    at = lambda p: F.get_json_object("manifest", p)
    dot = F.coalesce(at("$.exports['.']"), at("$.exports"))
    condition = F.coalesce(*[F.get_json_object(dot, f"$.{k}") for k in ("import", "require", "default")])
    exports = F.when(dot.startswith("{"), condition).otherwise(dot)
    given = F.transform(F.array_compact(F.array(exports, at("$.module"), at("$.main"))), lambda p: F.regexp_replace(p, r"^(\./)+", ""))
    bases = F.concat(given, F.array(F.lit("index"), F.lit("src/index")))

    def tries(base: Column) -> Column:
        sources = [F.when(base.endswith(e), F.concat(F.substring(base, F.lit(1), F.length(base) - len(e)), F.lit(x))) for e, to in BUILT_FROM.items() for x in to]
        return F.array_compact(F.array(base, *[F.concat(base, F.lit(e)) for e in PROBED], *sources, *[F.concat(base, F.lit("/index" + e)) for e in PROBED]))

    every = packages.select("root", F.posexplode(F.flatten(F.transform(bases, tries))).alias("k", "name"))
    found = every.withColumn("path", F.concat_ws("/", F.when(F.col("root") != "", F.col("root")), "name")).join(files.select("path").distinct(), "path")
    return found.groupBy("root").agg(F.min_by("path", "k").alias("entry"))
