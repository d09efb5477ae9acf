"""What is shuffled, made or walked must not grow faster than the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import closure, corpus, joins, linkers
from orrery.plans import registry
from orrery.sources import tables


@pytest.fixture
def shuffled(spark):
    """The records that Spark writes to shuffles while a function runs."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def run(action):
        before = total()
        out = action()
        return out, total() - before

    return run


def test_neighbours_deal_out_each_text_once(spark, shuffled):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((600, 40)) < np.linspace(0.5, 0.01, 40), rng.integers(1, 9, (600, 40)), 0.0)
    x[:, 0] += x.sum(1) == 0
    x[100:140] = x[99]
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(x @ x.T, 9)
    want = {(i, int(j), r) for i in range(600) for r, j in enumerate([j for j in np.lexsort((np.arange(600), -cos[i])) if j != i and cos[i, j] > 0][:6], 1)}
    v = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "id long, term string, w double").cache()
    v.count()
    for heavy, products in ((256, 1 << 22), (5, 1 << 22), (5, 100)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(corpus, "HEAVY", heavy)
            m.setattr(corpus, "PRODUCTS", products)
            got, records = shuffled(lambda: corpus.neighbours(v, 6, 20).collect())
        assert {(r.id, r.other, r.rank) for r in got} == want
        # Dealt to each pair of 30 blocks, the texts alone would be 18,000 and their neighbours 100,000 records.
        assert records < 35_000


def test_spans_meet_places_by_lines_not_by_symbols(spark, shuffled):
    rng = np.random.default_rng(1)
    spans = [(i, "f", int(a), int(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 60, 9_000), rng.choice([3, 20, 70], 9_000), strict=True))]
    points = [(i, "f", int(x)) for i, x in enumerate(rng.integers(0, 130, 12_000))]

    def best(x, y, i):
        of = min(((e - s, c) for c, _, s, e in two if s <= x and y <= e and c != i), default=None)
        return of and of[1]

    # Of equal spans only the two smallest can be an answer.
    two = [r for g in {x[2:] for x in spans} for r in sorted(x for x in spans if x[2:] == g)[:2]]
    want = {(i, best(x, x, i)) for i, _, x in points}
    df = spark.createDataFrame(spans, "container long, path string, start int, `end` int")
    run = lambda: joins.innermost_container(spark.createDataFrame(points, "id long, path string, line int"), df).collect()
    got, records = shuffled(run)
    assert {tuple(r) for r in got} == {w for w in want if w[1] is not None} and len(got) > 9_000
    assert records < 40_000
    symbols = spark.createDataFrame([(f"s{c:05}", "f", "r", s, e, [("controller", "route")[c % 2]]) for c, _, s, e in spans], "id string, path string, name string, start int, `end` int, concepts array<string>")
    groups = sorted((e - s, f"s{c:05}", s, e) for c, _, s, e in spans if c % 2 == 0)
    routes = {(f"s{c:05}", next(((g[1], g[2]) for g in groups if g[2] <= s and e <= g[3]), None)) for c, _, s, e in spans[:400] if c % 2}
    got = {r.dst: (r.src, r.line) for r in linkers.grouped_routes(symbols, "controller").collect()}
    assert {(d, got.get(d)) for d, _ in routes} == routes


def test_a_route_is_not_its_own_group(spark):
    rows = [("a", "f", "r", 1, 9, ["route", "controller"]), ("b", "f", "r", 1, 9, ["controller"]), ("c", "f", "r", 1, 9, ["controller"]), ("d", "g", "r", 1, 9, ["route", "controller"])]
    symbols = spark.createDataFrame(rows, "id string, path string, name string, start int, `end` int, concepts array<string>")
    assert [tuple(r) for r in linkers.grouped_routes(symbols, "controller").collect()] == [("b", "a", 1, 0.8, False)]


def test_dispatch_reaches_ancestors_of_any_depth(spark, tmp_path):
    # p_partkey // 3 leads from 2 * 3 ** 14 to 2 in 14 steps.
    rows = [(0, 1, "ECONOMY"), (2, 1, "PROMO"), (52, 9, "SMALL"), (102, 9, "LARGE")]
    rows += [(2 * 3**k, 1 if k == 14 else 9, "LARGE") for k in range(1, 15)] + [(5 * 3**k, 1 if k == 13 else 9, "ECONOMY") for k in range(14)]
    rows += [(k * 50 + x % 50, 9, t) for k, t in ((10_000_001, "SMALL"), (10_000_002, "LARGE")) for x in (2 * 3**14, 5 * 3**13)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in registry.QUERIES["framework_dispatch"](spark, str(tmp_path)).collect()}
    called = {("operators", 2): ("SMALL", "PROMO"), ("hooks", 5): ("LARGE",)}
    want = {(c, m, f) for c, base in ((2 * 3**14, 2), (5 * 3**13, 5)) for (f, b), names in called.items() if b == base for m, _, t in rows if m % 50 == c % 50 and t in names}
    assert got == want and len(want) > 1


def test_dispatch_makes_its_result_rows_once(spark):
    make = spark.createDataFrame
    rules = make([("f", 1, "run"), ("f", 2, "run"), ("f", 2, "stop"), ("g", 2, "run")], "framework string, base long, method_name string")
    up = make([(c, b) for c in range(10, 30) for b in (1, 2, 3) if b != 2 or c % 2], "class long, base long")
    classes = make([(c, c % 4) for c in range(10, 40)], "class long, scope long")
    methods = make([(s, n, m) for m in range(60) for s, n in ((m % 4, ("run", "stop", "other")[m % 3]), (m % 4, "stop" if m % 5 == 0 else "none"))], "scope long, name string, method long")
    got = [tuple(r) for r in joins.dispatch(up, classes, methods, rules).collect()]
    names = {m: {("run", "stop", "other")[m % 3]} | ({"stop"} if m % 5 == 0 else set()) for m in range(60)}
    want = {(c, m, f) for c in range(10, 30) for m in range(60) if m % 4 == c % 4 for f, b, n in (("f", 1, "run"), ("f", 2, "run"), ("f", 2, "stop"), ("g", 2, "run")) if n in names[m] and (b != 2 or c % 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_derived_edges_are_walked_and_not_made(spark, shuffled):
    make = spark.createDataFrame
    edges = make([("root", "a0"), ("b1", "c")], "src string, dst string")
    into, out = make([(f"a{i}", i % 3) for i in range(3_000)], "src string, at int"), make([(i % 3, f"b{i}") for i in range(3_000)], "at int, dst string")
    got, records = shuffled(lambda: closure.reach(make([("root",), ("a1",)], "id string"), edges, 3, through=(into, out)).collect())
    want = {"root": 0, "a1": 0, "a0": 1, "c": 2} | {f"b{i}": 1 if i % 3 == 1 else 2 for i in range(3_000) if i % 3 < 2}
    assert {r.id: r.depth for r in got} == want and len(got) == len(want)
    assert records < 30_000  # made, the edges would be 3,000,000


def test_codes_stand_for_ids(spark):
    d = "/root/testdata/sf0.001"
    ids = lambda df, *more: df.select(tables.decoded("src").alias("src"), tables.decoded("dst").alias("dst"), *more)
    whole = tables.edges(spark, d)
    assert not ids(tables.coded_edges(spark, d), "type", "line", "confidence").exceptAll(whole.drop("id")).count()
    assert ids(tables.links(spark, d)).distinct().exceptAll(whole.select("src", "dst").distinct()).isEmpty() and whole.select("src", "dst").exceptAll(ids(tables.links(spark, d))).isEmpty()
    assert tables.coded_nodes(spark, d).select("label").exceptAll(tables.nodes(spark, d).select("id")).isEmpty()


def test_a_walk_reads_ready_edges_without_exchanging_them(spark, shuffled):
    links = spark.range(200_000).select(F.col("id").alias("src"), (F.col("id") * 7 % 200_000).alias("dst")).union(spark.range(60).select(F.lit(3).cast("long"), F.col("id") + 1_000))
    got, records = shuffled(lambda: closure.reach(spark.range(3, 4), links, 6, ready=True, hub=50).collect())
    want, at = {3: 0}, {3}
    for hop in range(1, 7):
        at = {y for x in at for y in [x * 7 % 200_000] + (list(range(1_000, 1_060)) if x == 3 else [])} - set(want)
        want |= dict.fromkeys(at, hop)
    assert {r.id: r.depth for r in got} == want
    assert records < 5_000
    assert {r.id for r in closure.reach(spark.range(2, 4).where("id = 3"), links.union(spark.range(1).select(F.lit(9).cast("long"), F.lit(3).cast("long"))), 2, ready=True, hub=50).collect()} >= {21, 1_000}


def test_components_move_forests_and_not_all_edges(spark, shuffled, monkeypatch):
    monkeypatch.setattr(closure, "FOREST", 20_000)
    e = spark.range(0, 200_000, 1, 4).select((F.col("id") % 100).alias("a"), (F.col("id") % 100 + 100 * (1 + F.col("id") % 7)).alias("b"))
    got, records = shuffled(lambda: closure.components(e).collect())
    assert {r.id: r.component for r in got} == {x + 100 * k: x for x in range(100) for k in [0, *{1 + i % 7 for i in range(x, 20_000, 100)}]} and len(got) == len({r.id for r in got})
    assert records < 60_000
    bare = closure.components(e, text=lambda c: F.concat(F.lit("n"), c)).where("id = 'n700'").collect()
    assert [tuple(r) for r in bare] == [("n700", "n0")]
