"""Blocks of Python source and packages' entries."""

import ast

import pytest

from orrery.functions import names
from orrery.operators import filters, joins
from orrery.sources import blocks
from pyspark.sql import functions as F

SOURCE = """import os

@decorator
def f(a, b=1):
    if a:
        def g():
            return 1
    for x in b:
        a += x
    return a


class C(Base):
    y: int = 3

    def f(self):
        try:
            pass
        except E:
            return 2

    class D:
        z = 1


if os:
    def h(): return 3
else:
    def h(): return 4
"""


def test_blocks_of_a_source():
    got = blocks.blocks_of(SOURCE)
    assert [b["name"] for b in got] == ["<module>", "f", "C", "h", "h#2", "f.g", "C.f", "C.D"]
    by = {b["name"]: b for b in got}
    assert (by["f"]["header_line"], by["f"]["first_line"], by["f"]["last_line"]) == (3, 5, 10)
    assert [b["name"] for b in got if b["import_time"]] == ["<module>", "C", "C.D"]
    assert by["f"]["spans"] == [(5, 7), (8, 9), (9, 9), (10, 10)]
    owner = blocks.owners(got)
    assert owner[1] == ("<module>", 0) and owner[7] == ("f.g", 0) and owner[5] == ("f", 0) and owner[9] == ("f", 2) and owner[20][0] == "C.f" and 6 not in owner and 3 not in owner and 13 not in owner


@pytest.mark.parametrize(
    ("old", "new", "changed"),
    [
        ("import os", "# a comment\n\nimport os", set()),
        ("a += x", "a -= x", {"f"}),
        ("return 1", "return 5", {"f.g"}),
        ("def g():", "def g(q):", {"f.g"}),
        ("z = 1", "z = 2", {"C.D"}),
        ("y: int = 3", "y: str = 3", {"C"}),
        ("import os", "import os, sys", {"<module>"}),
    ],
)
def test_digests_follow_a_blocks_own_shape(old, new, changed):
    before = {b["name"]: b["digest"] for b in blocks.blocks_of(SOURCE)}
    after = {b["name"]: b["digest"] for b in blocks.blocks_of(SOURCE.replace(old, new, 1))}
    assert {n for n in before if before[n] != after.get(n)} == changed
    ast.parse(SOURCE.replace(old, new, 1))


def test_blocks_of_odd_sources(spark):
    rows = [("a.py", "def f(:"), ("b.py", None), ("c.py", ""), ("d.py", "x = 1"), ("d.py", "x = 1")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = blocks.source_blocks(df).collect()
    assert sorted((r.path, r.error, r.statements) for r in got if r.error) == [("a.py", "SyntaxError", None)]
    assert sorted((r.path, r.name, r.statements) for r in got if not r.error) == [("c.py", "<module>", 0), ("d.py", "<module>", 1), ("d.py", "<module>", 1)]
    assert sorted((r.path, r.line) for r in blocks.statement_owners(df).collect()) == [("d.py", 1), ("d.py", 1)]
    assert blocks.source_blocks(df.where("false")).count() == 0


def test_process_files_and_test_paths(spark):
    paths = {"security.yaml": False, "authors.py": False, "SECURITY": True, "docs/Release_Notes.rst": True, "licence-mit": True, "license-a-b.md": False, "": False}
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    assert {r.path: r.p for r in df.select("path", names.is_process_file(F.col("path")).alias("p")).collect()} == paths | {None: False}
    reasons = {"a/Mocks/b.go": "mock", "mocks/db_test.py": "test", "a\\tests\\b.c": "test", "x/spec/y.py": None, "spec/y.py": "test", "benches/a.rs": "benchmark", "testing.py": None, "": None}
    df = spark.createDataFrame([(p,) for p in [*reasons, None]], "path string")
    assert {r.path: r.r for r in df.select("path", filters.test_reason(F.col("path")).alias("r")).collect()} == reasons | {None: None}


def test_package_entries_without_a_manifest_that_reads(spark):
    packages = spark.createDataFrame([("a", "{broken"), ("b", None), ("", '{"main": "./x.js"}'), ("c", '{"exports": {}}'), ("d", "{}")], "root string, manifest string")
    files = spark.createDataFrame([("a/index.ts",), ("b/src/index.js",), ("x.tsx",), ("c/index.js",), ("e/index.js",)], "path string")
    assert {(r.root, r.entry) for r in joins.package_entries(packages, files).collect()} == {("a", "a/index.ts"), ("b", "b/src/index.js"), ("", "x.tsx"), ("c", "c/index.js")}
