"""Operators over whole inputs, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import closure, corpus, vectors
from orrery.plans import registry
from orrery.sources import tables


def test_embedding_duplicates_are_all_found(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((4000, 64))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = 0.85 + 0.05 * np.linspace(0, 1, 4000)[:, None] ** 4 + 1e-9
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side, np.zeros((1, 64))])
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.85, 1)), strict=True)}
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert len(want) >= 4000
    for block in (vectors.BLOCK, 1_500):
        got = [(r.a, r.b) for r in vectors.duplicates(items, 0.85, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert vectors.duplicates(items.where("false"), 0.85).count() == 0


@pytest.fixture
def small(monkeypatch):
    """Puts a graph of the test's own in place of the encoded tables."""
    from orrery.plans import closures

    def put(edges, nodes=None):
        monkeypatch.setattr(closures, "edges", lambda *_: edges)
        if nodes is not None:
            monkeypatch.setattr(closures, "nodes", lambda *_: nodes)

    return put


def _parts(links):
    label = {x: x for e in links for x in e}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_a_whole_graph(spark, small):
    rng = np.random.default_rng(5)
    links = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 90, (60, 2)) if a != b] + [("hub", f"h{i}") for i in range(50)]
    small(spark.createDataFrame(links, "src string, dst string"))
    want = _parts(links)
    assert {r.id: r.component for r in registry.QUERIES["connected_components"](spark, "").collect()} == want
    sizes = {r.component: r.size for r in registry.QUERIES["component_sizes"](spark, "").collect()}
    assert len(sizes) > 3 and sizes == {c: list(want.values()).count(c) for c in want.values()}


def test_components_have_every_node_with_an_edge(spark):
    d = "/root/testdata/sf0.001"
    ends = {x for r in tables.edges(spark, d).select("src", "dst").collect() for x in r}
    got = [r.id for r in registry.QUERIES["connected_components"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == ends


def test_reverse_walk_has_ten_levels(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"f{i}.py") for i in range(14)] + [("t", "tests/test_t.py"), ("u", "tests/test_u.py"), ("x", None)], "id string, path string")
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(13)] + [("t", "n2"), ("u", "n13"), ("x", "n0")], "src string, dst string")
    files = lambda *x: spark.createDataFrame([(f,) for f in x], "path string")
    got = closure.dependent_files(nodes, edges, nodes.where("id = 'n0'"))
    assert {r.path for r in got.collect()} == {f"f{i}.py" for i in range(10)} | {"tests/test_t.py"}
    extra = closure.extra_seeds(nodes, edges, files("f0.py"), files("f0.py", "f1.py", "f12.py", "gone.py"), F.col("path").startswith("tests/"))
    assert {tuple(r) for r in extra.collect()} == {("seed", "f1.py"), ("seed", "f12.py"), ("seed", "gone.py"), ("test", "tests/test_u.py")}


def test_files_behind_an_order_are_found(spark):
    got = {r.path for r in registry.QUERIES["dependent_files"](spark, "/root/testdata/sf0.001").collect()}
    assert {"geo/regions.sql"} <= got and any(p.startswith("geo/") and p.endswith("nations.sql") for p in got) and any(p.startswith("customer/") for p in got)


def test_neighbours_by_common_terms(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((90, 30)) < np.linspace(0.8, 0.02, 30), rng.integers(1, 9, (90, 30)), 0.0)
    x[3], x[4] = x[5], 0
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    cos = np.round(x @ x.T, 9)
    want = {(i, int(j), r) for i in range(90) for r, j in enumerate([j for j in np.lexsort((np.arange(90), -cos[i])) if j != i and cos[i, j] > 0][:6], 1)}
    v = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "id long, term string, w double")
    for block in (corpus.BLOCK, 25):
        assert {(r.id, r.other, r.rank) for r in corpus.neighbours(v, 6, block).collect()} == want
    assert corpus.neighbours(v.where("false"), 6).count() == 0


def test_tags_of_sliced_probes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 8))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    probes = items.where("id < 20").select(F.concat(F.lit("p"), "id").alias("name"), "v")
    want = {i: sorted(f"p{j}" for j in range(20) if unit[i] @ unit[j] >= 0.3) for i in range(50)}
    for most in (vectors.PROBES, 6):
        monkeypatch.setattr(vectors, "PROBES", most)
        assert {r.id: r.tags for r in vectors.tag(items, probes, 0.3).collect()} == want
