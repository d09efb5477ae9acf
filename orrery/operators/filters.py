"""Tier, noise, kind and test filters over nodes and edges.

Nodes: id, name, kind, path, language, tier; edges: src, dst, type, line, confidence. All are semi, anti or plain filters,
so that predicates reach the scans and no operator gathers ids on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds and languages that the definitions name.
NOISE_KINDS = ("table_array", "code_block", "link", "label", "setting", "class_selector", "id_selector", "rule_set", "media", "keyframes", "font_face", "pattern", "requirement")
NOISE_BY_LANGUAGE = {
    "variable": ("css", "scss", "sass", "less"),
    "table": ("toml", "ini", "properties"),
    "property": ("properties", "qml", "objc"),
    "section": ("markdown", "rst", "latex", "ini", "kdl", "blade"),
}
EXCLUDED_KINDS = ("dependency", "file", "target", "special_target", "project", "package", "class_selector", "id_selector", "variable", "keyframes", "media", "font_face", "section", "code_block", "link")
EXCLUDED_ROLES = ("event_subscriber",)
KEY_KINDS = (
    "function", "class", "method", "constructor", "struct", "enum", "type", "record", "union", "abstract", "interface", "trait", "protocol", "module", "object", "namespace",
    "instance", "binding", "derivation", "input", "resource", "data", "variable", "output", "provider", "local", "const", "macro", "port", "table", "view", "procedure", "trigger",
    "stage", "value", "theorem", "inductive", "program", "subroutine", "entity", "architecture", "component",
)
EXAMPLE_DIRS = ("examples", "example", "demos", "demo", "samples", "sample", "playground", "tutorial", "tutorials")
# Folders of test or supporting code and why, names of whole test files, and annotations of tests.
TEST_FOLDERS = {
    "test": ("tests", "test", "t", "__tests__", "testing", "testsuite"),
    "mock": ("fakes", "mocks", "testfakes", "testmocks"),
    "fixture": ("fixtures", "testdata", "testfixtures"),
    "test_support": ("testutils", "testutil", "testhelper", "testhelpers", "fv", "harnesses"),
    "benchmark": ("bench", "benches", "benchmark", "benchmarks"),
}
TEST_SOURCE_SETS = ("inttest", "integrationtest", "unittest")
TEST_FILES = ("tests.py", "tests.rs", "testonly.rs")
TEST_ANNOTATIONS = ("test", "Test", "tokio::test", "actix_rt::test", "async_std::test", "org.junit.Test", "org.junit.jupiter.api.Test", "TestMethod", "Fact", "Theory")


def test_reason(path: Column) -> Column:
    """Why a path looks like test or supporting code: test, mock, fixture, test_support or benchmark; null for production code.

    File names come before folders, and of the folders the first with a reason counts.
    """
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    file = F.substring_index(unix, "/", -1)
    low = F.lower(file)
    stem = F.when(low.contains("."), F.regexp_replace(low, r"\.[^.]*$", "")).otherwise(low)
    named = file.startswith("test_") | file.startswith("spec_") | low.startswith("test-") | file.endswith("Tests.swift") | low.isin(*TEST_FILES)
    for mark in ("_test.", ".test.", "_spec.", ".spec."):
        named = named | low.contains(mark)
    named = named | low.rlike(r"\.test-d\.tsx?$") | file.rlike(r"(Test|Tests|IT)\.(java|kt|scala)$")
    mocked = F.lit(False)
    for word in ("mock", "fake"):
        mocked = mocked | stem.startswith(f"{word}_") | stem.endswith(f"_{word}")
    parts = F.split(F.lower(unix), "/")
    folder = F.lit(None).cast("string")
    known = F.create_map(*[F.lit(x) for reason, names in TEST_FOLDERS.items() for n in names for x in (n, reason)])
    why = lambda p: F.coalesce(F.element_at(known, p), F.when(p.endswith("fakes") | p.endswith("mocks"), "mock").when(p.startswith("test-") | p.startswith("testsuite"), "test"))
    folder = F.get(F.filter(F.transform(parts, why), lambda x: x.isNotNull()), 0)
    above = F.slice(parts, 1, F.size(parts) - 1)
    sets = F.arrays_overlap(above, F.array(*map(F.lit, TEST_SOURCE_SETS))) | F.concat(F.lit("/"), F.array_join(above, "/"), F.lit("/")).contains("/src/integration/") | (F.get(parts, 0) == "spec")
    return F.when(named, "test").when(mocked, "mock").otherwise(F.coalesce(folder, F.when(sets, "test")))


def has_test_annotation(annotations: Column) -> Column:
    """Whether one of array<struct<name, args>> marks a test: by its name, or a configuration for tests."""
    marked = lambda a: a["name"].isin(*TEST_ANNOTATIONS) | ((a["name"] == "cfg") & F.array_contains(a["args"], "test"))
    return F.coalesce(F.exists(annotations, marked), F.lit(False))


def is_noise(kind: Column, language: Column, by_language: dict[str, tuple[str, ...]] = NOISE_BY_LANGUAGE) -> Column:
    """Documentation, configuration and styling kinds, some of them in certain languages only; null languages aren't noise."""
    out = kind.isin(*NOISE_KINDS)
    for k, languages in by_language.items():
        out = out | ((kind == k) & F.coalesce(language.isin(*languages), F.lit(False)))
    return out


def is_excluded_kind(kind: Column, role: Column, language: Column, section_languages: tuple[str, ...] = NOISE_BY_LANGUAGE["section"]) -> Column:
    """Kinds that selections leave out; a section counts by its language if that is known, functions by their role."""
    return (
        F.when((kind == "section") & language.isNotNull(), language.isin(*section_languages))
        .when(kind.isin(*EXCLUDED_KINDS), True)
        .when(kind.isin("function", "method"), F.coalesce(role.isin(*EXCLUDED_ROLES), F.lit(False)))
        .otherwise(False)
    )


def is_test_path(path: Column) -> Column:
    """Test or supporting code by its path."""
    return test_reason(path).isNotNull()


def is_test_node(path: Column, annotations: Column) -> Column:
    """Test code by its path or by an annotation."""
    return is_test_path(path) | has_test_annotation(annotations)


def is_example_path(path: Column) -> Column:
    return F.lower(path).rlike("(^|/)(" + "|".join(EXAMPLE_DIRS) + ")/")


def is_key_symbol(kind: Column, path: Column, name: Column, tier: Column, annotations: Column | None = None) -> Column:
    """A declaration, not test code, not named like a test, not derived."""
    test = is_test_path(path) if annotations is None else is_test_node(path, annotations)
    return kind.isin(*KEY_KINDS) & ~test & ~name.contains("test_") & (tier != 4)


def production_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source isn't a test node, by path or by ``annotations`` where nodes have them; sources that aren't nodes stay."""
    test = is_test_node(F.col("path"), F.col("annotations")) if "annotations" in nodes.columns else is_test_path(F.col("path"))
    tests = nodes.where(test).select(F.col("id").alias("src")).distinct()
    return edges.join(tests, "src", "left_anti")


def tier_filter(nodes: DataFrame, edges: DataFrame, max_tier: int, is_route: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept nodes, kept edges, paths left out): tiers up to ``max_tier``.

    Derived nodes (tier 4) that bear routes count as tier 1. Edges go with either end that is left out; ends which are no
    nodes at all (boundaries) keep their edges.
    """
    promoted = nodes.withColumn("tier", F.when((F.col("tier") == 4) & is_route, 1).otherwise(F.col("tier")))
    kept = promoted.where(F.col("tier") <= max_tier)
    gone = promoted.where(F.col("tier") > max_tier)
    ids = gone.select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left.select(*edges.columns), gone.select("path").distinct()


def search(nodes: DataFrame, pattern: str, limit: int, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Names that hold ``pattern`` whatever the case, with the true total; the limit is the feature."""
    found = nodes.where(F.lower("name").contains(pattern.lower()))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if language is not None:
        found = found.where(F.col("language") == language)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("name", "id").limit(limit).select("id", "name", "kind").crossJoin(F.broadcast(total))  # a single row


def confidence_in_band(confidence: Column, low: float, high: float) -> Column:
    return confidence.between(low - 1e-9, high + 1e-9)
