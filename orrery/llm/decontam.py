"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

The CGK walk maps a word sequence S to E: with i = 0, step j writes S[i] and moves on by one where bit j of a random
function of S[i] is set. Two sequences at edit distance k get embeddings at Hamming distance O(k^2) with constant
probability, whatever their length. Several walks each sample positions of the embedding; equal samples of a window
and of an item (a repetition of bit-sampling LSH) make a candidate, and the edit distance of the words decides.

How many walks are taken and how many positions a sample has follows from the item's length and the wanted recall: the
share of positions at which the walks of an item and of a copy with all allowed edits agree is found by simulation, once
for each class of lengths.

A window has as many words as the item and may begin at any word. A window within k edits of an item of n words shares at
least n - q + 1 - k q runs of q words with it, so only windows around so many such runs are embedded. Windows of one item
that begin near each other are a region; its first candidate has the whole region searched exactly, once. Items are
handled in blocks of bounded size; documents are never reduced.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of an item's words that may be edited.
MAX_EDIT = 0.2
#: Share of the items' edited copies, with all allowed edits, which the LSH is to find.
RECALL = 0.998
#: Samples of one walk, and the walks there may be; positions of a sample in order of preference.
BANDS, WALKS, SAMPLED = 6, (4, 8, 12, 16, 24, 32, 48, 64, 96, 128), (3, 2, 1)
#: Share of the 2 n steps from which positions are sampled: most walks are through with their n words at the end.
STEPS = 0.9
#: Bytes of benchmark text that one pass over the documents handles.
BLOCK_BYTES = 16 << 20
#: Windows that are embedded at once.
WINDOWS = 1 << 13
_SEED = 77
_ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word int, window_words int"


def edit_distance(a: list, b: list, most: int) -> int:
    """Levenshtein distance of two sequences, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1] if row[-1] <= most else most + 1


def best_window(item: np.ndarray, words: np.ndarray, most: int) -> tuple[int, int, int]:
    """(distance, begin, end) of the part of ``words`` nearest to ``item``: least distance, then first, then shortest."""
    n = len(words)
    cost = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    for x in item:
        up, ub = cost + 1, begin
        diag = cost[:-1] + (words != x)
        new = up.copy()
        nb = ub.copy()
        better = diag <= new[1:]
        new[1:][better] = diag[better]
        nb[1:][better] = begin[:-1][better]
        # Insertions run left to right: cost[j] = min over i <= j of new[i] + (j - i).
        slack = new - np.arange(n + 1)
        at = np.maximum.accumulate(np.where(slack == np.minimum.accumulate(slack), np.arange(n + 1), 0))
        cost = slack[at] + np.arange(n + 1)
        begin = nb[at]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Walks:
    """CGK walks with sampled positions, over whole arrays of windows."""

    def __init__(self, walks: int, sampled: int, bands: int = BANDS, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.walks, self.bands, self.sampled = walks, bands, sampled
        self.salt = rng.integers(1, 2**63, walks, dtype=np.uint64)
        self.draw = rng.random((walks, bands, sampled)) * STEPS

    def embedding(self, r: int, words: np.ndarray, begin: np.ndarray, length: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """(steps, windows): what walk ``r`` writes for the windows of ``length`` words from ``begin``; a window ends at its text's ``stop``."""
        steps = int(2 * STEPS * int(length.max(initial=1))) + 1
        limit = np.minimum(begin + length, stop)
        padded = np.append(words, np.uint64(0))
        last = len(words)
        at = begin.copy()
        out = np.empty((steps, len(begin)), np.uint64)
        salts = common.mix(self.salt[r] + np.arange(steps, dtype=np.uint64) * _ODD)
        for j in range(steps):
            out[j] = symbol = padded[np.where(at < limit, at, last)]
            at += ((symbol ^ salts[j]) * _ODD >> np.uint64(63)).astype(np.int64)
        return out

    def keys(self, r: int, words: np.ndarray, begin: np.ndarray, length: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """(windows, bands) keys of walk ``r``."""
        written = self.embedding(r, words, begin, length, stop)
        column = np.arange(len(begin))
        out = np.empty((len(begin), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(begin), np.uint64(1 + r * 64 + b))
            for draw in self.draw[r, b]:
                key = common.mix(key * _ODD + written[(draw * 2 * length).astype(np.int64), column])
            out[:, b] = key
        return out


def length_class(n: int) -> int:
    """The class of an item's length: the least power of two, or three halves of one, that isn't smaller."""
    c = 4
    while c < n:
        c = c * 3 // 2 if c & (c - 1) == 0 else c // 3 * 4
    return c


@functools.lru_cache(maxsize=256)
def plan(n: int, rate: float, recall: float, trials: int = 48) -> tuple[int, int]:
    """(walks, sampled positions) with which an item of ``n`` words and a copy at its largest distance meet with ``recall``.

    Copies have substitutions, insertions and deletions; the first combination that is enough is taken, with more positions
    preferred to fewer, or else the largest.
    """
    rng = np.random.default_rng(n)
    texts, at = [], [0]
    for _ in range(trials):
        item = rng.integers(1, 1 << 62, n).tolist()
        copy = list(item)
        for kind in rng.integers(0, 4, int(n * rate)).tolist():
            i = int(rng.integers(len(copy)))
            if kind == 1:
                copy.insert(i, int(rng.integers(1, 1 << 62)))
            elif kind == 2 and len(copy) > 1:
                del copy[i]
            else:
                copy[i] = int(rng.integers(1, 1 << 62))
        for x in (item, copy):
            texts += x
            at.append(len(texts))
    words, at = np.array(texts, np.uint64), np.array(at)
    length = np.full(2 * trials, n)
    one = Walks(24, 1)
    agree = np.empty((24, trials))
    for r in range(24):
        e = one.embedding(r, words, at[:-1], length, at[1:])
        agree[r] = (e[:, ::2] == e[:, 1::2]).mean(0)
    for walks in WALKS:
        for sampled in SAMPLED:
            # A walk's samples miss together; over walks the misses of one pair multiply.
            miss = np.exp(np.log(np.maximum(1e-300, (1 - agree**sampled) ** BANDS)).mean(0) * walks)
            if 1 - miss.mean() >= recall:
                return walks, sampled
    return WALKS[-1], 1


def word_distance(n: int, rate: float = MAX_EDIT) -> int:
    return int(n * rate)


def _data(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


class Index:
    """The items of one block, by run of words and by LSH key."""

    def __init__(self, items: list[tuple[int, str]], rate: float = MAX_EDIT, recall: float = RECALL):
        w = common.Words(*_data([t for _, t in items]), common.NOT_ALNUM)
        self.ids = [item for item, _ in items]
        self.words = [w.hash[a:b] for a, b in zip(w.doc[:-1], w.doc[1:], strict=True)]
        self.n = np.diff(w.doc)
        self.most = (self.n * rate).astype(np.int64)
        q = np.clip((self.n - self.most) // (self.most + 1), 1, 3)
        #: Runs that a window within reach shares with its item at least (q-gram lemma).
        self.least = np.maximum(1, self.n - q + 1 - self.most * q)
        #: By class of length: its walks, the place of each item in it, and for each walk the items' keys.
        self.classes: list[tuple[Walks, list[np.ndarray]]] = []
        self.kind, self.place = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        kinds = np.array([length_class(n) for n in self.n.tolist()], np.int64)
        for c in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == c)
            walks = Walks(*plan(c, rate, recall))
            self.kind[own], self.place[own] = len(self.classes), np.arange(len(own))
            begin, end = w.doc[:-1][own].astype(np.int64), w.doc[1:][own].astype(np.int64)
            self.classes.append((walks, [walks.keys(r, w.hash, begin, self.n[own], end) for r in range(walks.walks)]))
        self.runs = {}
        for size in sorted(set(q[self.n > 0].tolist())):
            h, whole = common.grams(w, size)
            at = np.flatnonzero(whole)
            item = np.searchsorted(w.doc, at, "right") - 1
            own = q[item] == size
            at, item = at[own], item[own]
            order = np.argsort(h[at], kind="stable")
            at, item = at[order], item[order]
            bits = np.zeros(1 << 22, bool)
            bits[(h[at] >> np.uint64(42)).astype(np.int64)] = True
            self.runs[size] = (bits, h[at], item, at - w.doc[item])

    def seeds(self, w: common.Words) -> tuple[np.ndarray, ...]:
        """(text, item, first word) of the windows to embed: those around enough runs of their item."""
        found = []
        for size, (bits, known, item, at) in self.runs.items():
            h, whole = common.grams(w, size)
            if not len(h):
                continue
            may = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)] & whole)
            lo, hi = np.searchsorted(known, h[may]), np.searchsorted(known, h[may], "right")
            times = hi - lo
            p = np.repeat(may, times)
            which = np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            found.append((p, item[which], at[which]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        p, item, at = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        text = np.searchsorted(w.doc, p, "right") - 1
        order = np.lexsort((p, item, text))
        p, item, at, text = p[order], item[order], at[order], text[order]
        group = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])] if len(p) else np.zeros(0, bool)
        place = np.r_[True, p[1:] != p[:-1]] | group if len(p) else group
        rank = np.cumsum(place)
        # Enough different places of one (text, item) within the words that a window may span?
        near = np.zeros(len(p) + 1, np.int64)
        edges = np.r_[np.flatnonzero(group), len(p)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = item[a]
            if rank[b - 1] - rank[a] + 1 < self.least[k]:
                continue
            far = a + np.searchsorted(p[a:b], p[a:b] + self.n[k] + self.most[k], "right") - 1
            good = np.flatnonzero(rank[far] - rank[a:b] + 1 >= self.least[k])
            np.add.at(near, a + good, 1)
            np.add.at(near, far[good] + 1, -1)
        keep = np.cumsum(near)[:-1] > 0
        p, item, at, text = p[keep], item[keep], at[keep], text[keep]
        most = self.most[item]
        times = 2 * most + 1
        begin = np.repeat(p - at - most, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, text = np.repeat(item, times), np.repeat(text, times)
        begin = np.maximum(begin, w.doc[text])
        left = w.doc[text + 1] - begin >= np.maximum(1, self.n[item] - self.most[item])
        every = np.unique(np.stack([text[left], item[left], begin[left]], 1), axis=0)
        return every[:, 0], every[:, 1], every[:, 2]

    def candidates(self, w: common.Words, text: np.ndarray, item: np.ndarray, begin: np.ndarray, region: np.ndarray) -> np.ndarray:
        """The regions in which a window's sample equals its item's."""
        hit = np.zeros(int(region[-1]) + 1 if len(region) else 0, bool)
        stop = w.doc[text + 1].astype(np.int64)
        for c, (walks, known) in enumerate(self.classes):
            every = np.flatnonzero(self.kind[item] == c)
            for i in range(0, len(every), WINDOWS):
                own = every[i : i + WINDOWS]
                for r in range(walks.walks):
                    own = own[~hit[region[own]]]
                    if not len(own):
                        break
                    keys = walks.keys(r, w.hash, begin[own], self.n[item[own]], stop[own])
                    hit[region[own[(keys == known[r][self.place[item[own]]]).any(1)]]] = True
        return np.flatnonzero(hit)

    def matches(self, w: common.Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, words) for the texts of ``w``: the nearest window of each pair within reach."""
        text, item, begin = self.seeds(w)
        if not len(text):
            return
        most = self.most[item]
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > most[1:] + 1)]
        region = np.cumsum(new) - 1
        first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for x in self.candidates(w, text, item, begin, region).tolist():
            t, k = int(text[first[x]]), int(item[first[x]])
            far = int(self.most[k])
            lo, hi = int(w.doc[t]), int(w.doc[t + 1])
            begun = max(lo, int(begin[first[x]]) - far)
            d, s, e = best_window(self.words[k], w.hash[begun : min(hi, int(begin[last[x]]) + len(self.words[k]) + 2 * far)], far)
            found = (d, begun + s - lo, e - s)
            if d <= far and ((t, k) not in best or found < best[t, k]):
                best[t, k] = found
        for (t, k), (d, start, n) in sorted(best.items()):
            yield t, self.ids[k], d, start, n


_indexes: dict[str, Index] = {}


def index_of(key: str, items: list[tuple[int, str]], rate: float, recall: float) -> Index:
    """The index of a block, which a worker process keeps from task to task."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items, rate, recall)
    return _indexes[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = MAX_EDIT, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, window_words): pairs whose item lies in the document.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. Words are runs of letters and digits
    in lower case. A pair counts if some part of the document is within ``rate`` times the item's words of the item, in
    word edits; its nearest part is given (the first of equals). Null and empty texts or items match nothing; repeated
    rows give repeated pairs; an empty benchmark or table gives no rows.
    """
    spark = common.session(docs)
    common.bounded_batches(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = None
    for block in item_blocks(items):
        small = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text, or one item

        def search(batches, small=small, key=uuid.uuid4().hex):
            index = index_of(key, small.value, rate, recall)
            for batch in batches:
                ids = batch.column(0)
                rows = []
                for i, _, data, offsets in common.text_slices(batch.column(1), 2 << 20):
                    w = common.Words(data, offsets, common.NOT_ALNUM)
                    size = dict(zip(index.ids, index.n.tolist(), strict=True))
                    rows += [(ids[i + t].as_py(), item, d, size[item], first, n) for t, item, d, first, n in index.matches(w)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "item_words", "first_word", "window_words"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``most`` bytes, so that what is broadcast never grows with the benchmark."""
    block, size = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        n = len(row[1].encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = MAX_EDIT) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; null doc_ids are kept."""
    bad = common.cut(contaminated(docs, benchmark, rate).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
