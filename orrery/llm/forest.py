"""MinHash near-duplicates with an LSH forest.

Every text gets minwise hashes of its word shingles. A tree of the forest orders the signatures by its own sequence of
hashes; texts which share the longest prefix stand beside each other. Candidates of a text are, in each tree, its
neighbours in that order and the head of its region, the texts that share a prefix. A region begins at the depth that
gives the wanted recall; where it is crowded, its texts also get the heads of the deeper regions that they share,
so depth follows density. The order is a range sort over all tasks, in which a crowded region takes as many tasks as it
needs: each tells its last row, and the first rows of the next one are paired with that. Tests of signatures drop candidates which can hardly be near, and full shingle sets decide.

Candidates give groups, whose texts then meet once: inside a group all pairs are compared that its links have not yet
joined, so that links the candidate pairs miss are found, too. Groups beyond ``GROUP_ROWS`` or ``GROUP_BYTES`` are never
gathered: their candidate pairs are compared one by one, and what these leave outside the largest part of a group then
meets the rest of it, block by block. Equal shingle sets are one class from the start, and only its first document goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Minwise hashes of a signature.
HASHES = 120
#: A group of candidates is compared in one task up to so many classes and bytes of text.
GROUP_ROWS = 4_000
GROUP_BYTES = 48 << 20
#: Regions with more members get heads at deeper levels.
CROWD = 16
#: So many ids of large groups are broadcast to find their texts, about 12 MB; of more, all texts are dealt out by id once.
FEW_IDS = 1 << 18
#: A key with more than this share of the rows is joined apart from others.
HOT_KEYS = 2_000
#: Where numbers for rows without an id begin.
NAMELESS = 1 << 62
#: Standard deviations of the estimated similarity that a candidate may lie below the threshold.
SLACK = 5.0

_MUL = np.random.default_rng(31).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def depth_for(threshold: float, miss: float = 1e-5) -> int:
    """Deepest first level (hashes of a tree) at which HASHES // depth trees miss a pair at the threshold with at most ``miss``."""
    best = 1
    for r in range(1, 13):
        if (1 - threshold**r) ** (HASHES // r) <= miss:
            best = r
    return best


def shingle_sets(w: common.Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a shorter text is one shingle, one without words has none."""
    g, whole = common.grams(w, k)
    out = []
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif n:
            h = np.uint64(n)
            for x in w.hash[a:b]:
                h = common.mix(np.array([h ^ x]) * np.uint64(0x9E3779B97F4A7C15))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) 32-bit minwise hashes of sets that aren't empty."""
    every = np.concatenate(sets)
    begin = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((every * _MUL[k]) >> np.uint64(32), begin)
    return out


SIGNED = "doc_id long, n_shingles long, key binary, sig binary, trees array<struct<k:long,d:long>>"


def sign(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """SIGNED of every row of (doc_id, text); texts without words have a null key."""
    common.bounded_batches(common.session(docs))
    r = depth_for(threshold)
    trees = HASHES // r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("k", pa.int64()), ("d", pa.int64())])
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in common.text_slices(batch.column(1)):
                sets = shingle_sets(common.Words(data, offsets), k)
                full = [x for x, s in enumerate(sets) if len(s)]
                n = np.array([len(s) for s in sets], np.int64)
                key: list = [None] * (j - i)
                sig: list = [None] * (j - i)
                tree: list = [None] * (j - i)
                if full:
                    sigs = signatures([sets[x] for x in full])
                    wide = sigs.astype(np.uint64)
                    heads, deep = [], []
                    for t in range(trees):
                        h = np.full(len(full), np.uint64(t + 1))
                        for c in range(r):
                            h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, (t * r + c) % HASHES])
                        d = np.zeros(len(full), np.uint64)
                        for c in range(r, r + 4):  # four more levels, 16 bits each
                            d = (d << np.uint64(16)) | (wide[:, (t * r + c) % HASHES] & np.uint64(0xFFFF))
                        heads.append(h)
                        deep.append(d)
                    flat = pa.StructArray.from_arrays([pa.array(np.stack(x, 1).ravel().view(np.int64)) for x in (heads, deep)], fields=list(kind))
                    for row, x in enumerate(full):
                        s = sets[x]
                        both = np.array([np.add.reduce(common.mix(s)), np.bitwise_xor.reduce(common.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))), len(s)], np.uint64)
                        key[x] = both.tobytes()
                        sig[x] = (sigs[row] & 0xFF).astype(np.uint8).tobytes()
                        tree[x] = row
                    at = np.array([0 if t is None else 1 for t in tree]) * trees
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(at)], pa.int32()), flat)
                else:
                    lists = pa.nulls(j - i, pa.list_(kind))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), lists], names=["doc_id", "n_shingles", "key", "sig", "trees"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def classes(signed: DataFrame) -> DataFrame:
    """A row per different shingle set: rep (its smallest doc_id), its number of documents and what ``sign`` found."""
    least = F.min(F.struct("doc_id", "n_shingles", "sig", "trees")).alias("m")
    return signed.where("key is not null").groupBy("key").agg(least, F.count("*").alias("copies")).select("key", F.col("m.doc_id").alias("rep"), "copies", F.col("m.n_shingles").alias("n"), "m.sig", "m.trees")


def running_least(values: np.ndarray, new: np.ndarray, carried: int | None) -> np.ndarray:
    """Before each value the least of its run so far, and at the end that of the last run; the value itself where ``new`` begins one.

    ``carried``: the least of a run that goes on from before.
    """
    known, rank = np.unique(values if carried is None else np.append(values, carried), return_inverse=True)
    run = np.cumsum(new) + 1 - int(new[0])  # 1: the run that goes on, or the first one
    own = np.r_[rank[-1:] if carried is not None else rank[:1], rank[: len(values)]]
    runs = np.r_[1, run] * len(known)
    least = known[np.minimum.accumulate(own - runs) + runs]
    before = np.where(new, values, least[:-1])
    return np.append(before, least[-1])


#: Deeper levels of a region: bits of ``d`` that two texts of a level don't share.
LEVELS = (48, 32)


def neighbours(reps: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a < b) of the forest: order neighbours and heads of regions at adaptive depth."""
    spark = reps.sparkSession
    common.bounded_batches(spark)
    rows = reps.select("rep", F.posexplode("trees").alias("t", "s")).select(F.col("t").cast("long").alias("t"), "s.k", "s.d", "rep")
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "t", "k", "d", "rep").sortWithinPartitions("t", "k", "d", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the row before: its key (t, k, d), rep, place in its region, and the heads so far of the region and its levels. A head
        # is the least rep so far: in all trees mostly the same one, so that its pairs are few.
        last: list[int] | None = None
        first: tuple | None = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends", pa.list_(pa.int64()))])
        for batch in batches:
            t, k, d, rep = (np.asarray(c) for c in batch.columns)
            n = len(rep)
            if not n:
                continue
            if first is None:
                first = (int(t[0]), int(k[0]), int(d[0]), int(rep[0]))
            new = np.ones(n, bool)
            new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            goes_on = last is not None and last[0] == t[0] and last[1] == k[0]
            new[0] = not goes_on
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, 0))
            opened = np.maximum.accumulate(new)  # False: in the region that the last batch left open
            place = at - start + np.where(opened, 0, last[4] + 1 if goes_on else 0)
            before = np.r_[rep[:1] if last is None else [last[3]], rep[:-1]]
            pairs = [(before[~new], rep[~new])]
            least = running_least(rep, new, last[5] if goes_on else None)
            pairs.append((least[:-1][place > 0], rep[place > 0]))
            heads = [int(least[-1])]
            for i, bits in enumerate(LEVELS):
                level = d.view(np.uint64) >> np.uint64(bits)
                begin = new.copy()
                begin[1:] |= level[1:] != level[:-1]
                same = goes_on and (np.int64(last[2]).view(np.uint64) >> np.uint64(bits)) == level[0]
                begin[0] = not same
                least = running_least(rep, begin, last[6 + i] if same else None)
                crowded = (place >= CROWD) & ~begin
                pairs.append((least[:-1][crowded], rep[crowded]))
                heads.append(int(least[-1]))
            last = [int(t[-1]), int(k[-1]), int(d[-1]), int(rep[-1]), int(place[-1]), *heads]
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            unlike = a != b
            a, b = np.minimum(a, b)[unlike], np.maximum(a, b)[unlike]
            both = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.list_(pa.int64()))], schema=schema)
        if first is not None:
            ends = [*first, *last[:4], *last[5:]]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    # The tasks' ends are written with the pairs, so that both come from one division into ranges.
    found = common.cut(ordered.mapInArrow(run, "a long, b long, ends array<long>"))
    e = lambda i: F.col("ends")[i]
    order = Window.orderBy(e(0), e(1), e(2), e(3))  # a row for each task
    was = [F.lag(e(4 + i)).over(order).alias(f"p{i}") for i in range(5 + len(LEVELS))]
    seams = found.where("ends is not null").select(e(0).alias("t"), e(1).alias("k"), e(3).alias("rep"), *was).where("t = p0 and k = p1")
    seams = seams.select("rep", F.explode(F.array(*[f"p{i}" for i in range(3, 5 + len(LEVELS))])).alias("other")).where("rep <> other")
    seams = seams.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    return found.where("a is not null").select("a", "b").unionByName(seams).distinct()


def plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes and signatures don't rule the threshold out."""
    least = threshold - SLACK * (threshold * (1 - threshold) / HASHES) ** 0.5

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
        return pd.Series((x == y).mean(1) >= least)

    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9))
    return both.where(alike("sa", "sb")).select("a", "b")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets of distinct hashes."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(both) - inter)


def join_group(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """Index of the part of each set: all pairs are compared but those that are already joined. Heads with most in common come first."""
    n = len(sets)
    part = list(range(n))

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    if n > 2:
        # The set nearest to what most sets hold is compared first: copies with single changes then join at once.
        every, times = np.unique(np.concatenate(sets), return_counts=True)
        common_ones = every[times * 2 > n]
        near = [-len(np.intersect1d(s, common_ones, assume_unique=True)) / max(1, len(np.union1d(s, common_ones))) for s in sets]
        order = sorted(range(n), key=lambda i: (near[i], ids[i]))
    else:
        order = list(range(n))
    left = n - 1
    for at, i in enumerate(order):
        if not left:
            break
        for j in order[at + 1 :]:
            a, b = root(i), root(j)
            if a != b and linked(sets[i], sets[j], percent):
                part[max(a, b)] = min(a, b)
                left -= 1
    return [root(i) for i in range(n)]


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows with null, empty or blank text have no shingles and link with nothing. Repeated doc_ids give repeated rows of
    one component. Rows without a doc_id (smaller than 2 ** 62) link like others, but never name a component while it has
    any id: then component_id is null. kept marks the document with the smallest id of its component. An empty table gives
    no rows.
    """
    threshold = percent / 100
    # Without an id, a number made from the text stands in for it, above all ids.
    stand_in = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(NAMELESS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select(F.coalesce("doc_id", stand_in).alias("doc_id"), "text")
    signed = common.cut(sign(texts, k, threshold))
    named = common.cut(classes(signed))
    reps = named.select("rep", "n", "sig", "trees")
    pairs = common.cut(plausible(neighbours(reps), reps, threshold))
    groups = common.components(pairs)
    sized = groups.join(reps.select(F.col("rep").alias("id"), "n"), "id")
    totals = sized.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("mass"))
    # A shingle stands for a word of the text, about 8 bytes in the task's memory.
    small = totals.where((F.col("rows") <= GROUP_ROWS) & (F.col("mass") * 8 <= GROUP_BYTES)).select("component")
    members = common.cut(sized.join(small.withColumn("small", F.lit(True)), "component", "left"))
    in_small = members.where("small").select(F.col("id").alias("doc_id"), "component")
    gathered = texts.join(in_small, "doc_id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
        ids = pdf["doc_id"].tolist()
        part = join_group(ids, _sets(pdf["text"], k), percent)
        return pd.DataFrame({"id": ids, "component": [ids[p] for p in part]})

    done = gathered.groupBy("component").applyInPandas(compare, "id long, component long")
    done = common.cut(done)
    large = members.where("small is null").select("id", "n", "component")
    many = large.count()
    if many:
        # The texts of large groups are set apart once: every later step would deal out all texts again.
        wanted = large.select(F.col("id").alias("doc_id"))
        apart = texts.join(F.broadcast(wanted) if many <= FEW_IDS else wanted, "doc_id").dropDuplicates(["doc_id"])
        done = done.unionByName(_large(common.cut(apart), pairs, large, k, percent))
    labels = named.select("key", "rep", "copies").join(done.withColumnRenamed("id", "rep"), "rep", "left").select("key", "copies", F.coalesce("component", "rep").alias("label"))
    out = labelled(signed.select("doc_id", "n_shingles", "key"), common.cut(labels))
    label = F.coalesce("label", "doc_id")
    named_ = lambda c: F.when(c < NAMELESS, c)
    return out.select(named_(F.col("doc_id")).alias("doc_id"), "n_shingles", named_(label).alias("component_id"), (F.col("doc_id") == label).alias("kept"))


def labelled(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """``signed`` with the label of its key. Keys with more than a HOT_KEYS-th of all rows, fewer than HOT_KEYS, are broadcast."""
    total = labels.agg(F.sum("copies")).first()[0] or 0
    hot = labels.where(F.col("copies") > F.lit(total / HOT_KEYS)).select("key", F.col("label").alias("hot_label"))
    split = signed.join(F.broadcast(hot), "key", "left")
    cold = split.where("hot_label is null").drop("hot_label").join(labels.select("key", "label"), "key", "left")
    return split.where("hot_label is not null").withColumnRenamed("hot_label", "label").unionByName(cold)


def _verified(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are linked; each pair's two texts, one row of ``texts`` for an id, meet in one row."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    @F.pandas_udf("boolean")
    def link(ta: pd.Series, tb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ta, tb, strict=True):
            raw = [x.encode(), y.encode()]
            s = shingle_sets(common.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), k)
            out.append(linked(s[0], s[1], percent))
        return pd.Series(out, dtype=bool)

    return both.where(link("ta", "tb")).select("a", "b")


def _large(texts: DataFrame, pairs: DataFrame, large: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of groups too large for a task: (id, component) of ``large`` (id, n, component), whose rows (doc_id, text) ``texts`` holds.

    Candidate pairs are verified one by one first. What they leave outside the largest part of its group then meets all
    the group, in tasks of one block of either side; a task gives only the links that join parts.
    """
    ids = common.cut(large)
    links = common.cut(_verified(texts, pairs.join(ids.select(F.col("id").alias("a")), "a", "left_semi"), k, percent))
    label = ids.join(common.components(links).withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    label = common.cut(label)
    sizes = label.groupBy("component", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("mass"))
    main = sizes.groupBy("component").agg(F.max_by("part", F.struct("rows", -F.col("part"))).alias("main"), F.sum("rows").alias("rows"), F.sum("mass").alias("mass"))
    apart = sizes.join(main.select("component", "main"), "component").where("part <> main").groupBy("component").agg(F.sum("rows").alias("few"), F.sum("mass").alias("few_mass"))
    blocks = lambda rows, mass, most: F.greatest(F.lit(1), F.ceil(F.col(rows) / most), F.ceil(F.col(mass) * 8 / (GROUP_BYTES // 4))).cast("int")
    plan = common.cut(main.join(apart, "component").select("component", "main", blocks("rows", "mass", GROUP_ROWS / 2).alias("mbs"), blocks("few", "few_mass", GROUP_ROWS / 8).alias("sbs")))
    if plan.isEmpty():
        return label.select("id", F.col("part").alias("component"))
    held = texts.join(label.join(plan, "component").withColumnRenamed("id", "doc_id"), "doc_id")
    one = held.where("part <> main").withColumn("sb", F.pmod(F.xxhash64("doc_id"), F.col("sbs")).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)))
    two = held.withColumn("mb", F.pmod(F.xxhash64("doc_id"), F.col("mbs")).cast("int")).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("sbs") - 1)))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        left, right = left.drop_duplicates("doc_id"), right.drop_duplicates("doc_id")
        if len(left) and len(right):
            few, many = _sets(left["text"], k), _sets(right["text"], k)
            root = {int(x): int(x) for x in (*left["part"], *right["part"])}

            def top(x: int) -> int:
                while root[x] != x:
                    x = root[x]
                return x

            for i, x, a in zip(left["doc_id"].tolist(), few, left["part"].tolist(), strict=True):
                for j, y, b in zip(right["doc_id"].tolist(), many, right["part"].tolist(), strict=True):
                    u, v = top(a), top(b)
                    if u != v and linked(x, y, percent):
                        root[max(u, v)] = min(u, v)
                        out.append((i, j))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    columns = ["component", "sb", "mb", "doc_id", "text", "part"]
    one = one.select([F.col(c).alias(f"{c}_") for c in columns]).toDF(*columns)  # columns of its own
    more = one.groupBy("component", "sb", "mb").cogroup(two.select(columns).groupBy("component", "sb", "mb")).applyInPandas(compare, "a long, b long")
    # The new names keep Spark's optimizer from constraints of the checkpointed rows' past.
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(common.cut(more).select(F.col("a").alias("x"), F.col("b").alias("y")))
    joined = common.components(both.toDF("a", "b"))
    return ids.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _sets(texts: pd.Series, k: int) -> list[np.ndarray]:
    out = []
    for i in range(0, len(texts), 64):
        raw = [t.encode() for t in texts.iloc[i : i + 64]]
        out += shingle_sets(common.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), k)
    return out
