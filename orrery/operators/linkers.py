"""Linkers: rule tables that join symbols, inheritance, unresolved calls and source lines into new edges.

Symbols: id, name, kind, path, language, start, end and, where a rule asks for them, concepts, bases, decorators, modifiers.
Lines: path, language, line, text. Every linker gives (src, dst, line, confidence, fallback): where a name has several targets, the
smallest id is taken, at 0.5 and marked. Rules are equality joins on names, files or exported keys; tables of rules are
literals. Test code is left out where the rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import names

from . import filters
from .closure import reach
from .joins import innermost, narrowest

# Registries and the functions that walk them; framework bases and the methods that the framework calls.
REGISTRIES = {"register_analyzer": ("run_all_analyzers",), "register_linker": ("run_all_linkers",)}
AIRFLOW = {
    "BaseOperator": ("execute", "execute_complete", "pre_execute", "post_execute", "on_kill"),
    "BaseHook": ("get_conn", "test_connection"),
    "BaseSensor": ("poke", "execute", "execute_complete", "on_kill"),
    "BaseTrigger": ("run", "hook"),
    "BaseSensorOperator": ("poke", "execute", "execute_complete", "on_kill"),
}
MODULE_MARKER = "CaddyModule"
MODULE_METHODS = ("Provision", "Validate", "Cleanup", "Start", "Stop", "ServeHTTP")
SERIALIZED_CLASSES = (
    "JsonSerialize", "JsonDeserialize", "JsonIgnoreProperties", "JsonFormat", "JsonAutoDetect", "JsonRootName", "JsonTypeName", "JsonTypeInfo", "JsonPropertyOrder", "JsonInclude", "JsonNaming",
    "XmlRootElement", "XmlType", "XmlAccessorType", "ConfigurationProperties", "ConstructorBinding", "Entity", "MappedSuperclass", "Embeddable",
)
SERIALIZED_METHODS = ("JsonProperty", "JsonGetter", "JsonSetter", "JsonCreator", "JsonValue", "JsonAnyGetter", "JsonAnySetter", "JsonRawValue")
COMPONENT_BASES = ("Component", "PureComponent", "React.Component", "React.PureComponent")
SCRIPTS = ("javascript", "typescript")
NATIVE = ("c", "cpp", "rust")


def _edges(found: DataFrame, confidence: float) -> DataFrame:
    return found.groupBy("src", "dst").agg(F.min("line").alias("line")).select("src", "dst", "line", F.lit(confidence).alias("confidence"), F.lit(False).alias("fallback"))


def by_key(calls: DataFrame, targets: DataFrame, sure: float) -> DataFrame:
    """Calls (src, key, line) to targets (key, id); each (src, dst) once, at its first line."""
    one = targets.select("key", "id").distinct().groupBy("key").agg(F.min("id").alias("dst"), F.count("*").alias("n"))
    found = calls.join(one, "key").groupBy("src", "dst").agg(F.min("line").alias("line"), F.max("n").alias("n"))
    return found.select("src", "dst", "line", F.when(F.col("n") > 1, 0.5).otherwise(sure).alias("confidence"), (F.col("n") > 1).alias("fallback"))


def production(symbols: DataFrame) -> DataFrame:
    return symbols.where(~filters.is_test_node(F.col("path"), F.col("decorators")) if "decorators" in symbols.columns else ~filters.is_test_path(F.col("path")))


def grouped_routes(symbols: DataFrame, concept: str) -> DataFrame:
    """Symbols of a concept (controller, router) to the routes of their file whose spans lie in theirs: the narrowest one, 0.8."""
    own = production(symbols)
    groups = own.where(F.array_contains("concepts", concept)).select(F.col("id").alias("container"), "path", "start", "end")
    best = innermost(own.where(F.array_contains("concepts", "route")).select("id", "path", "start", "end"), groups)
    return best.select(F.col("x.container").alias("src"), F.col("id").alias("dst"), F.col("x.s").alias("line"), F.lit(0.8).alias("confidence"), F.lit(False).alias("fallback"))


def registry_dispatch(symbols: DataFrame, registries: dict[str, tuple[str, ...]] = REGISTRIES) -> DataFrame:
    """Functions that walk a registry to all that a decorator registers with it, 0.7. A symbol counts for its first known decorator."""
    known = F.get(F.filter(F.transform("decorators", lambda d: d["name"]), lambda n: n.isin(*registries)), 0)
    handlers = production(symbols).withColumn("family", known).where("family is not null").select(F.col("id").alias("dst"), "family")
    family = names.lookup(F.col("name"), {site: f for f, sites in registries.items() for site in sites}, None)
    sites = symbols.withColumn("family", family).where("family is not null").select(F.col("id").alias("src"), F.col("start").alias("line"), "family")
    return _edges(sites.join(handlers, "family"), 0.7)


def base_dispatch(symbols: DataFrame, inherits: DataFrame, table: dict[str, tuple[str, ...]], prefixes: tuple[str, ...], language: str, max_hops: int = 20) -> DataFrame:
    """Classes to the methods that a framework calls on them, by the framework bases on their chain of ancestors, 0.9.

    inherits: src, dst between classes. A base written without one of ``prefixes`` whose short name an own class bears, too,
    leaves it open which one is meant: such classes are marked.
    """
    classes = symbols.where((F.col("language") == language) & F.col("kind").isin("class", "struct"))
    written = classes.select("id", F.explode("bases").alias("raw")).withColumn("base", names.short_name(F.trim(F.substring_index("raw", "<", 1)))).where(F.col("base").isin(*table))
    qualified = F.lit(False)
    for p in prefixes:
        qualified = qualified | F.col("raw").startswith(p)
    own = classes.select(F.col("name").alias("base"), F.lit(True).alias("own")).distinct()
    hits = written.join(own, "base", "left").select("id", "base", (F.coalesce("own", F.lit(False)) & ~qualified).alias("open"))
    up = reach(classes.select("id", F.col("id").alias("class")), inherits, max_hops, key=("id", "class"))
    chain = up.join(hits, "id").groupBy("class").agg(F.collect_set("base").alias("bases"), F.max("open").alias("open"))  # bases of the table only
    rules = F.create_map(*[x for b, m in table.items() for x in (F.lit(b), F.array(*map(F.lit, m)))])
    wanted = chain.select("class", "open", F.explode(F.array_distinct(F.flatten(F.transform("bases", lambda b: F.element_at(rules, b))))).alias("method"))
    wanted = wanted.join(classes.select(F.col("id").alias("class"), F.col("name").alias("owner"), "path", F.col("start").alias("line")), "class")
    methods = symbols.where((F.col("kind") == "method") & (F.col("language") == language)).select(F.col("id").alias("dst"), "path", names.owner(F.col("name")).alias("owner"), names.short_name(F.col("name")).alias("method"))
    found = wanted.join(methods, ["path", "owner", "method"])
    return found.select(F.col("class").alias("src"), "dst", "line", F.when(F.col("open"), 0.5).otherwise(0.9).alias("confidence"), F.col("open").alias("fallback"))


def module_dispatch(symbols: DataFrame, marker: str = MODULE_MARKER, called: tuple[str, ...] = MODULE_METHODS, language: str = "go") -> DataFrame:
    """The marker method of a struct to the struct's other methods that its host calls, 0.9."""
    own = symbols.where(F.col("language") == language)
    methods = own.where("kind = 'method'").select("id", "path", "start", names.owner(F.col("name")).alias("owner"), names.short_name(F.col("name")).alias("short"))
    structs = own.where("kind = 'struct'").select("path", F.col("name").alias("owner")).distinct()
    marks = methods.where(F.col("short") == marker).join(structs, ["path", "owner"]).groupBy("path", "owner").agg(F.min(F.struct("id", "start")).alias("m"))
    found = marks.join(methods.where(F.col("short").isin(*called)), ["path", "owner"])
    return _edges(found.select(F.col("m.id").alias("src"), F.col("id").alias("dst"), F.col("m.start").alias("line")), 0.9)


def trait_dispatch(symbols: DataFrame, implements: DataFrame) -> DataFrame:
    """Traits to the methods of the structs that implement them, 0.85; methods that the trait itself declares are linked elsewhere.

    implements: src (struct), dst (trait). A trait without declared methods gives edges to all.
    """
    rust = symbols.where("language = 'rust'")
    methods = rust.where("kind = 'method'").select(F.col("id").alias("method"), F.col("path").alias("mpath"), names.owner(F.col("name")).alias("mowner"), names.short_name(F.col("name")).alias("short"))
    pairs = implements.join(rust.select(F.col("id").alias("src"), F.col("name").alias("mowner"), F.col("path").alias("mpath")), "src")
    traits = rust.select(F.col("id").alias("dst"), F.col("name").alias("trait"), F.col("path").alias("tpath"), F.col("start").alias("line"))
    found = pairs.join(traits, "dst").join(methods, ["mowner", "mpath"])
    declared = methods.select(F.col("mpath").alias("tpath"), F.col("mowner").alias("trait"), "short").distinct()
    return _edges(found.join(declared, ["tpath", "trait", "short"], "left_anti").select(F.col("dst").alias("src"), F.col("method").alias("dst"), "line"), 0.85)


def bean_dispatch(symbols: DataFrame) -> DataFrame:
    """Classes that are serialized, by an annotation of theirs or of one of their methods, to their get-, set- and is-accessors, 0.9."""
    marked = lambda table: F.exists("decorators", lambda d: names.short_name(d["name"]).isin(*table))
    own = symbols.where(F.col("language").isin("java", "kotlin", "scala"))
    methods = own.where("kind = 'method'").select("id", "path", names.owner(F.col("name")).alias("owner"), names.short_name(F.col("name")).alias("short"), F.coalesce(marked(SERIALIZED_METHODS), F.lit(False)).alias("m"))
    classes = own.where("kind = 'class'").select(F.col("id").alias("src"), "path", F.col("name").alias("owner"), F.col("start").alias("line"), F.coalesce(marked(SERIALIZED_CLASSES), F.lit(False)).alias("c"))
    by_method = methods.where("m").select("path", "owner", F.lit(True).alias("any")).distinct()
    chosen = classes.join(by_method, ["path", "owner"], "left").where("c or any")
    return _edges(chosen.join(methods.where(F.col("short").rlike("^(get|set|is)[A-Z]")), ["path", "owner"]).select("src", F.col("id").alias("dst"), "line"), 0.9)


def native_keys(name: Column) -> Column:
    """Class.method, and with a package also package.Class.method, of an exported Java_package_Class_method; _1 is an underscore."""
    parts = F.transform(F.split(F.replace(F.substring(name, 6, 10_000), F.lit("_1"), F.lit("\u0001")), "_"), lambda p: F.replace(p, F.lit("\u0001"), F.lit("_")))
    short = F.array_join(F.slice(parts, -2, 2), ".")
    return F.when(name.startswith("Java_") & (F.size(parts) >= 2), F.array_distinct(F.array(short, F.array_join(parts, "."))))


def native_bridge(symbols: DataFrame) -> DataFrame:
    """Native methods of Java to the functions of C, C++ or Rust that their name exports, 0.95."""
    calls = symbols.where((F.col("language") == "java") & (F.col("kind") == "method") & F.array_contains("modifiers", "native"))
    exports = symbols.where(F.col("language").isin(*NATIVE) & (F.col("kind") == "function")).select("id", F.explode(native_keys(F.col("name"))).alias("key"))
    return by_key(calls.select(F.col("id").alias("src"), F.col("name").alias("key"), F.col("start").alias("line")), exports, 0.95)


def unresolved_bridge(unresolved: DataFrame, symbols: DataFrame, scheme: str = "go:C:0-0:", sure: float = 0.9) -> DataFrame:
    """Unresolved calls (src, dst, line) into C by the name that their target carries, to functions of C and C++."""
    calls = unresolved.where(F.col("dst").startswith(scheme) & F.col("dst").endswith(":unresolved"))
    key = F.regexp_extract(F.substring("dst", len(scheme) + 1, 10_000), "^(.*):unresolved$", 1)
    targets = symbols.where(F.col("language").isin("c", "cpp") & (F.col("kind") == "function"))
    return by_key(calls.select("src", key.alias("key"), "line"), targets.select("id", F.col("name").alias("key")), sure)


def library_bridge(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of a Lua file through ffi.C or a library that it loads, to functions of C and C++, 0.85; names with _ first are left out."""
    lua = lines.where("language = 'lua'")
    direct = lua.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"ffi\.C\.(\w+)\s*\("), 1)).alias("key"), "line")
    loaded = lua.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)\s*=\s*ffi\.load\s*\(\s*[\"']\w+[\"']\s*\)"), 1)).alias("var")).distinct()
    member = lua.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+\.\w+)\s*\("), 1)).alias("call"))
    member = member.select("path", "line", F.substring_index("call", ".", 1).alias("var"), F.substring_index("call", ".", -1).alias("key")).join(loaded, ["path", "var"])
    calls = direct.unionByName(member.select(F.col("path").alias("src"), "key", "line")).where(~F.col("key").startswith("_"))
    targets = symbols.where(F.col("language").isin("c", "cpp") & F.col("kind").isin("function", "method"))
    return by_key(calls, targets.select("id", F.col("name").alias("key")), 0.85)


def contract_bridge(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src file, dst, line, confidence, fallback): the first call of each contract function in a script file, 0.75, to all of that name."""
    calls = lines.where(F.col("language").isin(*SCRIPTS)).select("path", "line", F.explode(F.concat(F.regexp_extract_all("text", F.lit(r"\.\s*(\w+)\s*\("), 1), F.regexp_extract_all("text", F.lit(r"functionName\s*:\s*['\"](\w+)['\"]"), 1))).alias("name"))
    first = calls.groupBy("path", "name").agg(F.min("line").alias("line"))
    targets = symbols.where((F.col("language") == "solidity") & F.col("kind").isin("function", "constructor")).select(F.col("id").alias("dst"), names.short_name(F.col("name")).alias("name"))
    return _edges(first.join(targets, "name").select(F.col("path").alias("src"), "dst", "line"), 0.75)


def component_usage(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """What renders to the component that it renders, 0.8: the narrowest function, method or class around a tag, or else its file."""
    scripts = symbols.where(F.col("language").isin(*SCRIPTS))
    component = F.col("name").rlike("^[A-Z][A-Za-z0-9]*$") | ((F.col("kind") == "class") & F.coalesce(F.arrays_overlap("bases", F.array(*map(F.lit, COMPONENT_BASES))), F.lit(False)))
    targets = scripts.where(F.col("kind").isin("function", "class") & component).select("id", F.col("name").alias("key"))
    tags = lines.where(F.col("language").isin(*SCRIPTS)).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"<\s*([A-Z][a-zA-Z0-9]*(?:\.[A-Z][a-zA-Z0-9]*)*)\s*[^>]*[>/]"), 1)).alias("key")).distinct()
    spans = scripts.where(F.col("kind").isin("function", "method", "class")).select(F.col("id").alias("container"), "path", "start", "end")
    around = narrowest(tags.select("path", F.col("line").alias("start"), F.col("line").alias("end")), spans)
    inner = around.select("path", F.col("start").alias("line"), F.col("first.container").alias("src"))
    calls = tags.join(inner, ["path", "line"], "left").select(F.coalesce("src", F.col("path")).alias("src"), "key", "line")
    return by_key(calls, targets, 0.8)


def template_handlers(symbols: DataFrame) -> DataFrame:
    """Directives (with ``handler``) to the script function, method, getter or setter of their file by that name, 0.9; the smallest id."""
    directives = symbols.where("kind = 'directive' and handler is not null").select(F.col("id").alias("src"), "path", F.col("handler").alias("short"), F.col("start").alias("line"))
    members = symbols.where(F.col("language").isin(*SCRIPTS) & F.col("kind").isin("function", "method", "getter", "setter")).groupBy("path", names.short_name(F.col("name")).alias("short")).agg(F.min("id").alias("dst"))
    return _edges(directives.join(members, ["path", "short"]), 0.9)


def graph_calls(documents: DataFrame, operations: DataFrame, fields: DataFrame) -> DataFrame:
    """Client documents (src, line, text) to operations (id, name) of their operation's name at 0.9, else to the schema's root field at 0.8.

    fields: id, name such as Query.users. The operation's type, query where none is written, selects the root type.
    """
    head = r"(?i)^\s*(query|mutation|subscription)\s+(\w+)"
    d = documents.select("src", "line", "text", F.regexp_extract("text", head, 2).alias("name"))
    kind = F.lower(F.regexp_extract("text", r"(?i)^\s*(query|mutation|subscription)\b", 1))
    root = F.initcap(F.when(kind == "", "query").otherwise(kind))
    d = d.withColumn("field", F.concat(root, F.lit("."), F.regexp_extract("text", r"\{\s*([A-Za-z_]\w*)", 1)))
    by_name = by_key(d.where("name <> ''").select("src", F.col("name").alias("key"), "line"), operations.select("id", F.col("name").alias("key")), 0.9)
    rest = d.join(operations.select("name").distinct(), "name", "left_anti")
    return by_name.unionByName(by_key(rest.select("src", F.col("field").alias("key"), "line"), fields.select("id", F.col("name").alias("key")), 0.8))


def concepts(symbols: DataFrame, patterns: list[tuple[str, str, str, str]]) -> DataFrame:
    """(id, framework, concept, value): what framework patterns find in decorators; each (symbol, pattern) once.

    patterns: framework, concept, a regular expression on a decorator's name, and one whose first group is taken from the name as
    value. The table is a catalogue's, written into the plan, so a symbol meets all patterns without a join.
    """
    hit = lambda d, p: F.when(d["name"].rlike(p[2]), F.struct(F.lit(p[0]).alias("framework"), F.lit(p[1]).alias("concept"), F.regexp_extract(d["name"], p[3], 1).alias("value")))
    found = F.array_distinct(F.array_compact(F.flatten(F.transform("decorators", lambda d: F.array(*[hit(d, p) for p in patterns])))))
    return symbols.select("id", F.explode(found).alias("x")).select("id", "x.*")
