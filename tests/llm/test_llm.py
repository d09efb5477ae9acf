"""The training-data operators against brute force, round trips and edge cases."""

import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import common, decontam, forest, html, license, mixing, sharding, tokens, toxicity, vptree, warc

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, family string, target string"


def rows(*texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, None, source(i), None, 9, "x", None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash."""
    data = rows(None, "", "  \n ", "one", "a b c d e f g h", "a b c d e f g h", "word " * 60_000, "é ñ 中文 😀 \x00 z")
    data += [data[4], (None, "null id text", None, None, None, None, None, None, None), (20, "x y", None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def parts(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


# --- words


@given(st.lists(st.text(alphabet="aAbB \n\té中", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_match_a_regular_expression(texts):
    w = common.Words(*parts(texts))
    for k, t in enumerate(texts):
        want = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        assert w.doc[k + 1] - w.doc[k] == len(want)
        if want:
            assert w.hash[w.doc[k] : w.doc[k + 1]].tolist() == common.hash_of([x.decode("utf-8", "surrogateescape") for x in want]).tolist()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in common.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in common.components(chain).collect()} == {0}
    assert common.components(edges.where("false")).collect() == []


def jobs(spark, run) -> int:
    """Spark jobs that ``run`` starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_components_take_few_jobs(spark):
    """The driver keeps what it knows of every job, stage and task; its memory must not grow with the rounds."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long").repartition(8)
    got = {}
    assert jobs(spark, lambda: got.update((r.id, r.component) for r in common.components(chain).collect())) <= 12
    assert got == dict.fromkeys(range(3001), 0)


@pytest.mark.parametrize("most", [1, 7, 64])
def test_components_beyond_a_task(spark, monkeypatch, most):
    rng = random.Random(most)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)]
    want = {x: x for a, b in pairs if a != b for x in (a, b)}
    while any(want[a] != want[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    monkeypatch.setattr(common, "TASK_EDGES", most)
    rows = common.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    assert {r.id: r.component for r in rows} == want and len(rows) == len(want)


# --- op1


def test_decontamination_finds_planted_passages(spark, odd):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch quietly from hills"
    words = item.split()
    near = " ".join(words[:4] + ["CHANGED"] + words[5:9] + words[10:])
    far = " ".join(words[::2])
    bench = spark.createDataFrame([(1, item, 3), (2, None, 3), (3, "", 3)], "item_id long, text string, doc_id int")
    data = spark.createDataFrame(rows(f"x y z {item.upper()}! more", f"before {near} after", far, "nothing here"), DOCS)
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(data, bench).collect()}
    assert got == {(0, 1): 0, (1, 1): 2}
    assert sorted(r.doc_id for r in decontam.decontaminate(data, bench).collect()) == [2, 3]
    assert decontam.contaminated(odd, bench).count() == 0
    assert decontam.decontaminate(odd, bench).count() == odd.count()
    assert decontam.contaminated(data, bench.where("false")).count() == 0


@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=150, deadline=None)
def test_best_window_is_exact(item, words):
    d, a, b = decontam.best_window(np.array(item), np.array(words, int), 3)
    every = [decontam.edit_distance(item, words[i:j], 99) for i in range(len(words) + 1) for j in range(i, len(words) + 1)]
    assert d == min(every) == decontam.edit_distance(item, words[a:b], 99)


def test_decontamination_recall_against_brute_force():
    """Items of 10 to 400 words, copies with none to all allowed edits: every window that an exact search finds, but for RECALL."""
    rng = np.random.default_rng(7)
    wanted = found = 0
    for n in (3, 10, 24, 80, 160, 320, 400):
        for rate in (0.0, 0.1, 0.2):
            items = [[f"w{x}" for x in rng.integers(0, 30_000, n)] for _ in range(12)]
            texts = []
            for i, item in enumerate(items):
                copy = list(item)
                for _ in range(int(n * rate)):
                    at, kind = int(rng.integers(len(copy))), i % 3 and int(rng.integers(3))
                    if kind == 1:
                        copy.insert(at, "inserted")
                    elif kind == 2:
                        del copy[at]
                    else:
                        copy[at] = f"z{i}"
                texts.append(" ".join([*(f"q{x}" for x in rng.integers(0, 3_000, 60)), *copy, *(f"q{x}" for x in rng.integers(0, 3_000, 60))]))
            index = decontam.Index([(i, " ".join(x)) for i, x in enumerate(items)])
            w = common.Words(*parts(texts), common.NOT_ALNUM)
            got = {(t, k): (d, a, m) for t, k, d, a, m in index.matches(w)}
            for t in range(12):
                for k in range(12):
                    d, a, b = decontam.best_window(index.words[k], w.hash[w.doc[t] : w.doc[t + 1]], 0)
                    assert ((t, k) in got) <= (d <= index.most[k])
                    if d <= index.most[k]:
                        wanted += 1
                        found += (t, k) in got
                        assert rate or (t, k) in got
                        if (t, k) in got:
                            assert got[t, k] == (d, a, b - a)
    assert wanted >= 12 * 21 and found >= 0.98 * wanted


# --- op2


def test_rendezvous_moves_little_and_counts_without_gaps(spark, docs, odd):
    got = sharding.shard_documents(docs, 8).toPandas()
    assert len(got) == docs.count() and got.shard.between(0, 7).all()
    moved = got[got.shard != got.grown_shard]
    assert (moved.grown_shard == 8).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got.itertuples():
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 1
    more = sharding.shard_documents(odd, 8).toPandas()
    assert len(more) == odd.count() and more[more.doc_id == 0]["size"].tolist() == [1] and more[more.doc_id == 0].text_crc32.tolist() == [0]
    assert sharding.shard_documents(odd.where("false"), 8).count() == 0


def test_shards_against_direct_computation(spark, docs, odd):
    import struct

    import xxhash

    def chosen(key, weights, seed):
        cost = []
        for s, w in enumerate(weights):
            h = 42
            for packed in ([] if key is None else [struct.pack("<q", key)]) + [struct.pack("<i", s), struct.pack("<i", seed)]:
                h = xxhash.xxh64(packed, seed=h).intdigest()
            if w > 0:
                cost.append((-math.log(((h >> 11) + 0.5) / 2.0**53) / w, s))
        return min(cost)[1]

    for table in (docs, odd):
        for r in sharding.shard_documents(table, 8).collect():
            assert (r.shard, r.grown_shard) == (chosen(r.doc_id, [1.0] * 8, 0), chosen(r.doc_id, [1.0] * 9, 0))
    weights = [0.5, 0.0, 2.0, 1.0]
    got = spark.range(300).transform(sharding.shard, "id", 4, weights, 9).collect()
    assert [r.shard for r in got] == [chosen(r.id, weights, 9) for r in got]


def test_weighted_shards(spark):
    n = spark.range(20_000).transform(sharding.shard, "id", 3, [1.0, 0.0, 3.0]).groupBy("shard").count().collect()
    got = {r.shard: r["count"] / 20_000 for r in n}
    assert set(got) == {0, 2} and abs(got[2] - 0.75) < 0.02


# --- op10


@given(st.lists(st.tuples(st.floats(0.1, 9), st.integers(0, 500)), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None)
def test_water_fill_matches_iteration(spark, sources):
    df = spark.createDataFrame([(f"s{i}", w, n) for i, (w, n) in enumerate(sources)], "source string, weight double, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(df).collect()}
    total = sum(n for _, n in sources)
    want, capped = {}, {i for i, (_, n) in enumerate(sources) if n == 0}
    while True:
        left = total - sum(3 * sources[i][1] for i in capped)
        weight = sum(w for i, (w, _) in enumerate(sources) if i not in capped)
        want = {i: 3 * sources[i][1] if i in capped else left * sources[i][0] / weight for i in range(len(sources))}
        over = {i for i in want if i not in capped and want[i] > 3 * sources[i][1] + 1e-9}
        if not over:
            break
        capped |= over
    for i, v in want.items():
        assert math.isclose(got[f"s{i}"], v, rel_tol=1e-9, abs_tol=1e-6)


def test_word_counts(spark, monkeypatch):
    texts = [None, "", "a", " a", "a ", " \t\n\x0b\x0c\r ", "a\tb\nc\x0bd\x0ce\rf  g", "\u00a0x\u2003y z", "\x1c\x85a", " ".join("ab" * 50) + "  " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [len(re.findall(mixing.WORD, t or "")) for t in texts]
    for most in (mixing.LONG, 3, 0):
        monkeypatch.setattr(mixing, "LONG", most)
        assert [r[0] for r in df.select(mixing.word_count(F.col("text"))).collect()] == want


def test_mixing(spark, docs, odd):
    for table in (docs, odd):
        got = mixing.mix_documents(table).toPandas()
        assert len(got) == table.count() and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
        g = got.groupby(got.source.fillna("~")).agg(t=("target", "first"), k=("taken", "sum"))
        assert ((g.t - g.k).abs() < 1).all()
        again = mixing.mix_documents(table).toPandas()
        assert sorted(map(str, again.itertuples(index=False))) == sorted(map(str, got.itertuples(index=False)))
    sizes = {r.doc_id: r["size"] for r in mixing.sizes(odd).collect()}
    assert sizes[0] == sizes[1] == sizes[2] == 0 and sizes[3] == 1 and sizes[6] == 60_000
    assert mixing.mix_documents(odd.where("false")).count() == 0


# --- op6


def brute_components(data, k, percent):
    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in data.items()}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = root(ids[a]), root(ids[b])
                part[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, docs, k, percent):
    want = brute_components({r.doc_id: r.text for r in docs.collect()}, k, percent)
    got = forest.near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == docs.count()


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    data = {}
    for i in range(120):
        words = list(base)
        for p in rng.integers(0, 120, 2):
            words[p] = f"z{i}-{p}"
        data[i] = " ".join(words)
    data[200], data[201] = "quite another text of nine words that stands alone", None
    df = spark.createDataFrame([(i, t) for i, t in data.items()], "doc_id long, text string")
    want = brute_components(data, 3, 85)
    for most in (4_000, 10):
        monkeypatch.setattr(forest, "GROUP_ROWS", most)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_duplicates(df, 3, 85).collect()}
        assert got == want


def shuffled(spark, run) -> int:
    """Bytes that the Spark jobs of ``run`` write for shuffles."""
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(spark.sparkContext._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize(("ids", "most"), [(1 << 18, 1.5), (10, 2.5)])
def test_near_duplicates_of_a_large_group_deal_out_other_texts_once(spark, monkeypatch, ids, most):
    """Besides the join for small groups, texts outside a group too large for a task go through no shuffle, or one if its ids are many.

    The group's two halves are candidates, but not linked, so that its blocks meet, too.
    """
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    data = {i: " ".join(base[:i] + [f"z{i}"] + base[i + 1 :]) for i in range(40)}
    for i in range(20, 40):
        data[i] = " ".join(w if p % 30 else f"y{p}" for p, w in enumerate(data[i].split()))
    other = {1000 + i: rng.bytes(12_000).hex(" ", 4) for i in range(300)}
    monkeypatch.setattr(forest, "GROUP_ROWS", 10)
    monkeypatch.setattr(forest, "FEW_IDS", ids)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([*data.items(), *other.items()], "doc_id long, text string").repartition(4).localCheckpoint()
        once = shuffled(spark, lambda: docs.repartition(4, "doc_id").foreach(lambda _: None))
        got = {}
        n = shuffled(spark, lambda: got.update((r.doc_id, r.component_id) for r in forest.near_duplicates(docs, 3, 85).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i - i % 20 for i in data} | {i: i for i in other}
    assert n <= most * once, n / once


def test_near_duplicates_of_odd_rows(spark, odd):
    got = forest.near_duplicates(odd, 3, 85).toPandas()
    assert len(got) == odd.count()
    by = got.dropna(subset="doc_id").groupby("doc_id").first()
    assert by.n_shingles[[0, 1, 2]].tolist() == [0, 0, 0] and by.component_id[5] == 4 and by.kept[3] and not by.kept[5]
    assert forest.near_duplicates(odd.where("false"), 3, 85).count() == 0


def test_near_duplicates_without_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    data = [(None, a), (4, a), (5, a), (7, a.replace("w30", "x")), (None, "some words that only nameless rows hold"), (None, "some words that only nameless rows hold"), (None, None), (9, None)]
    got = forest.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 4, False), (4, 4, True), (5, 4, False), (7, 4, False), (9, 9, True)]


@given(st.lists(st.tuples(st.integers(0, 50), st.booleans()), min_size=1, max_size=30), st.none() | st.integers(-5, 50))
@settings(max_examples=150, deadline=None)
def test_running_least(rows, carried):
    values, new = np.array([v for v, _ in rows]), np.array([n for _, n in rows])
    new[0] = carried is None
    got, least = forest.running_least(values, new, carried), carried
    for v, n, g in zip(values.tolist(), new.tolist(), got.tolist(), strict=False):
        assert g == (v if n else least)
        least = v if n else min(least, v)
    assert got[-1] == least


def crowded(families=4, members=60, words=80):
    """Families of texts around one text each, some of which differ from it in a few words, others hardly."""
    rng = np.random.default_rng(17)
    data, i = {}, 0
    for f in range(families):
        base = [f"f{f}w{x}" for x in rng.integers(0, 10_000, words)]
        for _ in range(members):
            own = list(base)
            for p in rng.integers(0, words, rng.integers(0, 5)):
                own[p] = f"z{i}-{p}"
            data[i] = " ".join(own)
            i += 1
    return data


@pytest.mark.parametrize(("partitions", "hot"), [(1, 2_000), (7, 3)])
def test_near_duplicates_of_crowded_regions(spark, monkeypatch, partitions, hot):
    data = crowded()
    data |= {1_000 + i: data[3] for i in range(90)}
    want = brute_components(data, 3, 85)
    monkeypatch.setattr(forest, "HOT_KEYS", hot)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_duplicates(df, 3, 85).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


# --- op7


def test_grammar():
    m = toxicity.grammar()
    assert m.walk(["Y", "o", "A6"])[-1] == ("y", 4.5) and m.walk(["A6"]) == [("I", 3.0)]
    assert m.walk(["A6", "o", "A6"])[-1] == ("I", 1.5)
    negated, reported = m.walk(["N", "o", "A6"])[-1], m.walk(["R", "o", "o", "A6"])[-1]
    assert negated[0] == "J" and np.isclose(negated[1], 0.3) and reported[0] == "K" and np.isclose(reported[1], 0.9)
    assert m.walk(["N", "o", "o", "o", "A6"])[-1] == ("I", 3.0)
    assert m.walk(["M", "V", "o", "Y"])[-1] == ("T", toxicity.THREAT) and [x for x, _ in m.walk(["V", "Y"])] == ["o", "Y"]
    assert m.walk(["M", "N", "V", "Y"])[-1][0] == "U" and m.walk(["N", "o", "o", "M", "V", "Y"])[-1][0] == "T"
    assert m.walk(["VA3"]) == [("I", 1.5)] and m.walk(["R", "M", "V", "Y"])[-1][0] == "W"


def plain_machine():
    """Every insult at its own weight; nothing else counts."""
    arcs = {x: (0, "I", toxicity.LEVEL * int(x.split("A")[1])) if "A" in x else (0, x, 1.0) for x in toxicity.ALPHABET}
    return toxicity.Fst({0: arcs})


def test_clause_patterns_decide():
    ill = ["you are an idiot", "you worthless moron", "the clown is a pathetic loser, you trash", "du bist ein Dummkopf"]
    good = ["you are an old friend and the weather is a joy", "the committee met at noon and you left", "not a word was said", "du bist ein guter Freund"]
    texts = [f"{t}. number {i}" for i in range(30) for t in ill + good]
    y = [1, 1, 1, 1, 0, 0, 0, 0] * 30
    scorer = toxicity.Scorer(toxicity.learn_arcs(texts, y))

    def features(s, x):
        data, offsets = parts(x)
        return s.features(common.Words(data, offsets, common.NOT_ALNUM), data)

    scorer.coefficients = toxicity.fit_logistic(features(scorer, texts), np.array(y, float))
    assert (scorer.coefficients[1:] >= 0).all()
    asked = ["You are an idiot.", "You are not an idiot.", "He said that you are an idiot.", "An idiot.", "I will hurt you.", "I will not hurt you.", "The farmers hurt the crop."]
    s = dict(zip(asked, scorer.score(features(scorer, asked)), strict=True))
    assert s["You are an idiot."] > s["An idiot."] > s["He said that you are an idiot."] > s["You are not an idiot."]
    assert s["I will hurt you."] > 0.5 > s["I will not hurt you."] and s["The farmers hurt the crop."] < 0.5
    plain = toxicity.Scorer(scorer.arcs, scorer.coefficients)
    plain.machine = plain_machine()
    other = dict(zip(asked, plain.score(features(plain, asked)), strict=True))
    assert {x for x in asked if (s[x] >= 0.5) != (other[x] >= 0.5)} >= {"You are not an idiot.", "He said that you are an idiot.", "I will hurt you."}


def test_toxicity(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_documents(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    p, n = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    assert ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2) > 0.8 and (n >= 0.5).mean() < 0.05
    more = toxicity.score_documents(odd, labels.where("false")).toPandas()
    assert len(more) == odd.count() and (more.predicted == 0).all()
    assert toxicity.reject(odd, labels.where("false")).count() == odd.count()
    assert toxicity.score_documents(odd.where("false"), labels).count() == 0


# --- op8


PAGES = "page_id long, url string, html string, path string, digest string"


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200
    data = [(5, "http://a/b c", big, "", ""), (3, None, big, "", ""), (9, "u", "short", "", ""), (8, "u", "short", "", ""), (1, "u", None, "", ""), (2, "u", "", "", ""), (7, "u\r\nX: y", "a\r\n\r\nb" * 30, "", ""), (3, None, big, "", "")]
    pages = spark.createDataFrame(data, PAGES)
    got = warc.archive(pages).toPandas()
    import hashlib

    assert len(got) == len(data)
    for page_id, _, h, _, _ in data:
        r = got[got.page_id == page_id].iloc[0]
        assert r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and r.payload_bytes == len((h or "").encode())
    five = got[got.page_id == 5].iloc[0]
    assert (five.record_type, five.refers_to) == ("revisit", 3) and (got[got.page_id != 5].record_type == "response").all()
    long = "x\r\n\r\nWARC/1.1\r\n" * 200_000
    one = warc.archive(spark.createDataFrame([(4, "u", long, "", "")], PAGES)).first()
    assert one.payload_bytes == len(long) and one.payload_digest == hashlib.sha256(long.encode()).hexdigest()
    packages = warc.write(pages, common.new_folder(spark, "t"))
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read(packages, payload=True).where("payload is not null").collect()}
    assert back == {i: h or "" for i, _, h, _, _ in data if i != 5}
    assert warc.archive(pages.where("false")).count() == 0


def test_zip_directory_in_its_64_bit_form(tmp_path):
    import struct
    import zipfile

    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", b"hello")
        z.writestr("b", b"world!")
    raw = path.read_bytes()
    end = raw.rfind(b"PK\x05\x06")
    for comment in (b"a comment", b"PK\x05\x06" * 7, b"x PK\x05\x06" + bytes(30)):
        noted = raw[:-2] + struct.pack("<H", len(comment)) + comment
        assert [m.name for m in warc.members(lambda at, n, x=noted: x[at : at + n], len(noted))] == ["a", "b"]
    count, length, begin = struct.unpack_from("<10xHII", raw, end)
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, begin)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = raw[:end] + record + locator + last
    read = lambda at, n: big[at : at + n]
    found = warc.members(read, len(big))
    assert [m.name for m in found] == ["a", "b"]
    at = warc.data_offset(read, found[1])
    assert big[at : at + found[1].size] == b"world!"


# --- op9


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.text(alphabet="'strevmldaB1é中 \n\t!<|endoft> 　²́\r😀", max_size=16), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_is_that_of_the_library(tokenizer, texts):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer)
    ids, per = tokens.encoder(open(tokenizer).read()).encode(*parts(texts))
    ends = np.cumsum(per)
    for t, a, b in zip(texts, ends - per, ends, strict=True):
        assert ids[a:b].tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_encoder_of_many_words(docs, tokenizer, monkeypatch):
    """Whole documents, with a cache that is forgotten now and then."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE", 3_000)
    fresh, e = Tokenizer.from_file(tokenizer), tokens.Encoder(open(tokenizer).read())
    texts = [r.text for r in docs.select("text").collect()]
    for i in range(0, len(texts), 20):
        ids, per = e.encode(*parts(texts[i : i + 20]))
        ends = np.cumsum(per)
        for t, a, b in zip(texts[i : i + 20], ends - per, ends, strict=True):
            assert ids[a:b].tolist() == fresh.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 400), max_size=300))
@settings(max_examples=40, deadline=None)
def test_table(keys):
    table, want = tokens.Table(2), {}
    for i in range(0, len(keys), 30):
        part = np.array(keys[i : i + 30], np.uint64) << np.uint64(40)
        assert table.find(part).tolist() == [want.get(x, -1) for x in part.tolist()]
        new = np.array([x for x in np.unique(part).tolist() if x not in want], np.uint64)
        table.add(new, np.arange(len(want), len(want) + len(new), dtype=np.int32))
        want |= {x: len(want) + j for j, x in enumerate(new.tolist())}


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "it's", "é", "中", "12", ""]), max_size=6).map("".join), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_keeps_added_tokens(tokenizer, texts):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer)
    ids, per = tokens.encoder(open(tokenizer).read()).encode(*parts(texts))
    ends = np.cumsum(per)
    for t, a, b in zip(texts, ends - per, ends, strict=True):
        assert ids[a:b].tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_added_tokens_in_token_files(spark, tokenizer):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer)
    texts = ["plain text", "one <|endoftext|> two", "<|endoftext|><|endoftext|>", "after"]
    got = tokens.tokenize_documents(spark.createDataFrame(rows(*texts), DOCS), tokenizer).orderBy("doc_id").collect()
    want = [[*fresh.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    assert 50256 in want[1] and [r.n_tokens for r in got] == [len(x) for x in want]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert [r.start for r in got] == [0, *np.cumsum([len(x) for x in want])[:-1]]


def test_token_files(spark, docs, odd, tokenizer):
    import pyarrow.parquet as pq

    e = tokens.encoder(open(tokenizer).read())
    for table in (docs, odd):
        manifest = tokens.write(table, tokenizer, common.new_folder(spark, "t"))
        got = tokens.read(manifest).toPandas().sort_values("start")
        assert len(got) == table.count() and got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
        assert got.doc_id.dropna().is_monotonic_increasing
        text = {r.doc_id: r.text or "" for r in table.collect() if r.doc_id is not None and r.doc_id != 6}
        for r in got.itertuples():
            if r.doc_id in text:
                ids = [*e.tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
                assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    meta = pq.ParquetFile(manifest.first().path.removeprefix("file:")).metadata.row_group(0)
    ids = meta.column(3)
    assert ids.path_in_schema.startswith("ids") and "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index and ids.has_column_index
    assert "DELTA_BINARY_PACKED" in meta.column(0).encodings
    assert tokens.read(manifest, ids=False).columns == ["doc_id", "start", "n_tokens"]
    assert tokens.tokenize_documents(odd.where("false"), tokenizer).count() == 0


# --- op4


def test_vantage_point_search(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in e.collect()]
    asked = [i for i, _ in table if i % 50 == 0]
    want = vptree.brute_force(table, asked, 5)
    exact = {}
    for r in vptree.nearest(e, e.where("vec_id % 50 = 0"), 5, factor=1.0).collect():
        exact.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in asked:
        assert [exact[q][k][0] for k in range(1, 6)] == [i for i, _ in want[q]]
        assert np.allclose([exact[q][k][1] for k in range(1, 6)], [s for _, s in want[q]], atol=1e-12)
    found = {(r.query_id, r.vec_id) for r in vptree.nearest(e, e.where("vec_id % 50 = 0"), 5).collect()}
    assert sum((q, i) in found for q in asked for i, _ in want[q]) >= 0.9 * 5 * len(asked)


def test_vantage_points_with_ties_and_odd_vectors(spark):
    v = [(i, [1.0, 0.0], 1, 1.0) for i in range(300)] + [(300, [0.0, 0.0], 1, 1.0), (301, None, 1, 1.0), (302, [float("nan"), 1.0], 1, 1.0), (303, [None, 1.0], 1, 1.0), (304, [1.0, float("inf")], 1, 1.0), (305, [1.0, 1.0], 1, 1.0), (None, [1.0, 2.0], 1, 1.0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, rank int, score double")
    got = [(r.rank, r.vec_id) for r in vptree.nearest(df, df.where("vec_id = 2"), 5, factor=1.0).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 3), (4, 4), (5, 5)]
    few = vptree.nearest(df.where("vec_id in (1, 305)"), df.where("vec_id = 1"), 5).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in few] == [(305, 0.707107)]
    assert vptree.nearest(df.where("false"), df, 5).count() == vptree.nearest(df, df.where("false"), 5).count() == 0
    ragged = df.union(spark.createDataFrame([(400, [1.0, 0.0, 0.0], 1, 1.0), (401, [], 1, 1.0)], df.schema))
    assert [r.vec_id for r in vptree.nearest(ragged, ragged.where("vec_id in (2, 400)"), 5, factor=1.0).orderBy("rank").collect()] == [0, 1, 3, 4, 5]


def test_vantage_points_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 40)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    table = [(i, [float(x) for x in rng.normal(size=8).astype("float32")]) for i in range(600)]
    df = spark.createDataFrame([(*r, 0, 0) for r in table], "vec_id long, embedding array<float>, shard int, asks int")
    asked = [i for i, _ in table if i % 10 == 0]
    want = vptree.brute_force(table, asked, 5)
    got = {}
    for r in vptree.nearest(df, df.where("vec_id % 10 = 0"), 5, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in want[q]] for q in asked}


# --- op5


def test_extraction(spark):
    filler = "Some words of the article that go on for a while. " * 4
    page = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style></head><body class="home">
    <header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div>
    <div class="content"><article class="post-12"><h1>Head&nbsp;line</h1><p>First&lt;<b>bold</b>  text\n here.<br>same block<p>Second {filler}
    <form>Sign up<input></form><div class="ad-box ads">buy</div><script>var a="</p><p>no</p>";</script><ul><li>one<li>two</ul></article>
    <aside>related</aside><section id="comments"><p>{filler * 3}</p></section></div><footer>&copy; me</footer>"""
    pages = spark.createDataFrame([(1, "http://h.org/1", page, "p"), (2, "http://h.org/2", page.replace("post-12", "post-77"), "p"), (3, None, None, "p"), (4, "http://h.org/3", "", "p"), (5, "x", "plain text &amp; no tags", "p"), (6, "http://h.org/4", "<div>other <p>place</div>", "p")], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    want = "\n".join(["Head line", "First<bold text here. same block", " ".join(f"Second {filler}".split()), "one", "two"])
    assert got[1].text == want and got[2].text == want and got[1].n_chars == len(want)
    assert got[3].text == got[4].text == "" and got[5].text == "plain text & no tags" and got[6].text == "other\nplace"
    twice = html.extract(pages.union(pages)).collect()
    assert sorted((r.page_id, r.text) for r in twice) == sorted((i, r.text) for i, r in got.items() for _ in range(2))
    long = html.extract(spark.createDataFrame([(1, "http://l", f"<article>{'<p>many words here</p>' * 100_000}</article>", "p")], pages.schema)).first()
    assert long.n_chars == 100_000 * 16 - 1
    assert html.extract(pages.where("false")).count() == 0


def whole(page):
    return html.text_at(*html.parse(page), None)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>one two</p><svg viewBox="0"/><p>three four five</p>', "one two\nthree four five"),
        ("<p>one</p><iframe src=x/ /><object/><math/><p>two</p>", "one\ntwo"),
        ("<p>one</p><iframe src='x'><p>no</p></iframe><svg><title>no</title><text>no</text></svg><p>two</p>", "one\ntwo"),
        ("<p title=it's>one</p><p data-x=\"a>b\" y='>'>two</p><p class=\"open>three</p>", "one\ntwo\nthree"),
        ("<article><p class=legal>one</p><div class=alert>two</div><label>three</label><p>x <math><mi>y</mi></math></p><span class='legal-history side'>four</span></article>", "one\ntwo\nthree\nx y\nfour"),
        ("<article>one<div class='share-buttons'>no</div><div class='cookie-notice'>no</div><div id=comments>no</div><div class='adBox2 left'>no</div></article>", "one"),
        ("<body><div class=legal>no</div><div class=search>no</div><p>one words here</p></body>", "one words here"),
        ("<article><p data-x='hidden' style='overflow:hidden'>one</p><p hidden>no</p><p style='display: none'>no</p></article>", "one"),
        ("<p>a < b &amp;&lt;c&gt; </> <!-- no -- > --> d<script src=x /></script><style>p{}</style><textarea><p>no</textarea></p>", "a < b &<c> d"),
        ("<a href=/x/>one</a> two<script>var x='</p>'", "one two"),
    ],
)
def test_extraction_of_odd_markup(page, want):
    assert whole(page) == want


def test_extraction_at_any_depth_and_size(spark):
    def nested(n, tail="", name="a"):
        return "<body>" + "".join(f"<div class='{name}-{i} {'x' * 70}{i}'>" for i in range(n)) + "<article>" + "<p>The article has these words of its own. " * 3 + "</article>" + tail + "</div>" * n

    for n in (1, 11, 12, 13, 14, 15, 16, 20, 300):
        noise = "<div><p>noise of another kind</p></div>"
        pages = spark.createDataFrame([(i, "http://h/x", nested(n, noise)) for i in range(2)], "page_id long, url string, html string")
        got = [r.text for r in html.extract(pages).collect()]
        assert got[0] == got[1] and "noise" not in got[0] and got[0].count("article") == 3
    import time

    took = []
    for n in (2_000, 16_000):
        began = time.time()
        text = whole("<body>" + "<div><p>some words stand here</p></div>" * n)
        took.append(time.time() - began)
        assert text.count("some") == n
    assert took[1] < 24 * took[0] + 0.5  # eight times as many containers, not their square
    deep = whole("<div>" * 20_000 + "words " * 10)
    assert deep == " ".join(["words"] * 10)


def test_extraction_of_the_given_pages(spark):
    import html as entities

    pages = spark.read.parquet(f"{D}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


# --- op3


def test_licences(spark, docs, odd):
    text = "Some ordinary words stand here and there.\nLicensed under the Apache License, Version 2.0.\nMore text follows. This work is licensed under the GNU General Public License, version 3. End"
    model = license.train(docs)
    df = spark.createDataFrame(rows(text, "The licence of a poet is wide and the version of events is free", "Released under the MIT License."), DOCS)
    got = license.scan(df, model).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(0, 1, "apache-2.0"), (0, 2, "gpl"), (2, 0, "mit")]
    first = next(r for r in got if r.family == "apache-2.0")
    assert text.encode()[first.begin : first.end].decode().strip() == "Licensed under the Apache License, Version 2.0."
    assert license.scan(odd, model).count() == 0 and license.scan(df.where("false"), model).count() == 0


def test_licence_calibration_does_not_hang_on_a_piece():
    """All templates pass and ordinary pieces don't, whatever the sample and whatever word it repeats."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in range(500)] + "the of work version in use and source public this software free".split()
    pieces = [" ".join(rng.choice(words, rng.integers(3, 40))) + "." for _ in range(12_000)]
    templates = [t for f in license.FAMILIES[1:] for t in license.TEMPLATES[f]]
    for seed in range(6):
        own = [pieces[i] for i in rng.permutation(len(pieces))[:6_000]] + ["Thshtion. " * 600, "software " * 700, "licensed. " * 500][: seed % 4]
        model = license.fit(own, seed=seed)
        assert (model.margins(templates) > model.threshold).all()
        assert (model.margins(pieces) > model.threshold).mean() <= license.FALSE_RATE
        assert model.margins(["version " * 900, "work. " * 2_000])[0] < model.threshold
        assert license.calibrate(model, [], templates).threshold <= 0.5


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n# "])
def test_licences_in_wrapped_paragraphs(spark, docs, end):
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a", "copy of this software and associated documentation files (the \"Software\"),", "to deal in the Software without restriction, including without limitation"]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"]
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 2 of the License, or", "(at your option) any later version."]
    apart = "Words of another kind stand here."
    texts = [f"{apart}\n\n{end.join(x)}\n \n{apart}" for x in (mit, bsd, gpl)] + [f"{apart}\n{bsd[0]}\n\n{bsd[1]}\n{apart}"]
    got = license.scan(spark.createDataFrame(rows(*texts), DOCS), license.train(docs)).collect()
    assert sorted((r.doc_id, r.family) for r in got) == [(0, "mit"), (1, "bsd"), (2, "gpl")]
    for r, x in zip(sorted(got), (mit, bsd, gpl), strict=True):
        assert texts[r.doc_id].encode()[r.begin : r.end].decode().startswith(x[0]) and r.paragraph == 2 and r.overlap > 0.9


def test_licences_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, f) for r in docs.collect() for f, p in (("apache-2.0", "Licensed under the Apache License, Version 2.0."), ("mit", "Released under the MIT License."), ("gpl", "licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0.")) if p in r.text}
    got = {(r.doc_id, r.family) for r in license.scan(docs).collect()}
    assert want <= got and not {f for _, f in got - want} & {"apache-2.0", "mit", "gpl", "cc-by-nc"}


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    base = spark.read.parquet(f"{D}/documents.parquet")
    docs, columns = base, base.columns
    seen = {}
    for name, stage in c.STAGES[:-1]:
        kept = common.cut(stage(spark, docs, D))
        assert kept.columns == columns
        seen[name] = {r.doc_id for r in kept.collect()}
        if name == "near_dedup":
            part = brute_components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
            assert seen[name] == {i for i, (_, root) in part.items() if i == root}
        if name == "mixing":
            plan = {r.doc_id: r.repeats for r in mixing.plan_mix(mixing.sizes(docs), whole_documents=True).collect()}
            n = {}
            for r in kept.collect():
                n[r.doc_id] = n.get(r.doc_id, 0) + 1
            assert n == {i: round(x) for i, x in plan.items() if round(x)}
        docs = kept
    last = c.STAGES[-1][1](spark, docs, D).toPandas()
    assert len(last) == docs.count()
    for _, g in last.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline as c

    for table, want in ((odd, True), (odd.where("false"), False)):
        docs = table
        for name, stage in c.STAGES[:-1]:
            kept = common.cut(stage(spark, docs, D))
            assert kept.columns == docs.columns
            if name in ("toxicity", "decontamination"):
                assert kept.count() == docs.count()
            docs = kept
        last = c.STAGES[-1][1](spark, docs, D)
        assert (last.count() > 0) == want
        if want:
            # Documents without words and without id are there, repeats of another's text are not; the mix may take short ones no time.
            assert {0, 1, 2, None} <= {r.doc_id for r in last.collect()} and 5 not in {r.doc_id for r in last.collect()}


def test_pipeline_near_duplicates_of_a_long_chain_take_few_jobs(spark, monkeypatch):
    """Every text is near the next one only, and the chain is too large for a task: the driver's share must stay small."""
    import corpus_pipeline as c

    monkeypatch.setattr(forest, "GROUP_ROWS", 20)
    data = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 60)), "en", "s", 0) for i in range(300)] + [(1000, "another text of its own", "en", "s", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = []
    n = jobs(spark, lambda: got.extend(r.doc_id for r in c.drop_near_duplicates(spark, docs, D).collect()))
    assert sorted(got) == [0, 1000]
    assert n <= 110, n
