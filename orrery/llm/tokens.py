"""Token ids in Parquet: list columns with page indexes, controlled row groups and a manifest.

Files hold the documents in ascending doc_id order, each its ids with the end id appended. Ids are dictionary-encoded,
16 bits each; the other columns are delta-encoded. Row groups end at a number of tokens and pages carry indexes, so that
a reader can fetch one document's ids, or counts and offsets without any ids. The place of a document in the sequence of
all ids is its file's first place plus its place in the file: the manifest has a row for each file.

Tokenizing whole texts splits them into pre-tokens first and looks for merges within each. Here the pre-tokens of many
texts are found at once, and each different one goes to the tokenizer once; for other kinds of tokenizers, whole
texts go to it. The results are the same.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

END_ID = 2
#: A row group ends once it holds so many ids or documents.
GROUP_TOKENS, GROUP_DOCS = 1 << 20, 4_096
PAGE_BYTES = 64 << 10
#: Different pre-tokens that a worker remembers.
CACHE = 2_000_000
#: New pre-tokens that go to the tokenizer in one string.
JOINED = 128

SCHEMA = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.field("element", pa.int32())))])


class Table:
    """An open-addressing hash table from 64-bit hashes to numbers, asked and filled by whole arrays."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.mask, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), (1 << bits) - 1, 0

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(17)).astype(np.int64) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the hashes, -1 for those that aren't there."""
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), self._place(h)
        while len(left):
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (key != 0)
            left, at = left[more], (at[more] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct hashes that aren't there."""
        if (self.used + len(h)) * 2 > len(self.keys):
            full = np.flatnonzero(self.keys)
            old = self.keys[full], self.values[full]
            self.__init__(int((self.used + len(h)) * 4).bit_length())
            self.add(*old)
        left, at = np.arange(len(h)), self._place(h)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            win = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[win]], self.values[at[win]] = h[left[win]], values[left[win]]
            more = np.ones(len(left), bool)
            more[win] = False
            left, at = left[more], (at[more] + 1) & self.mask
        self.used += len(h)


class Encoder:
    """Ids of many texts at a time, exactly those that the tokenizer gives for each whole text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        # An added token's content never comes apart into pre-tokens, so the cache is for texts without any.
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or [] if t["content"]]
        pre = spec.get("pre_tokenizer") or {}
        self.split = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.kind = np.full(0x110000, 255, np.uint8)
        # Words with a blank before them can go to the tokenizer end to end: ids that begin with the blank part them again.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.blank = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.blank[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.join = all(any(c != " " and not c.isalpha() for c in t.decode()) for t in self.added)
        self._forget()

    def _forget(self) -> None:
        self.known = Table()
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """0 white space, 1 letter, 2 number, 3 other, as the tokenizer's own pattern has it."""
        out = self.kind[points]
        if (out == 255).any():
            pieces = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
            for p in np.unique(points[out == 255]).tolist():
                c = chr(p)
                self.kind[p] = 1 if pieces("a" + c) == 1 else 2 if pieces("1" + c) == 1 else 3 if pieces("!" + c) == 1 else 0
            out = self.kind[points]
        return out

    def _starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens begin."""
        n = len(points)
        kind = self._kinds(points)
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        change = begin[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        white = kind == 0
        starts = change.copy()
        # A run of white space leaves its last character to what follows: with a following text as one token if it is a blank.
        nxt = np.ones(n, bool)  # this character is the last of its run
        nxt[:-1] = change[1:]
        last = white & nxt & ~begin[1:]
        blank = last & (points == 32)
        starts |= last
        follow = np.flatnonzero(blank) + 1
        starts[follow[follow < n]] = False
        # Contractions.
        q = np.flatnonzero((points == 39) & change & nxt)
        q = q[(q + 1 < n)]
        q = q[starts[q] & ~begin[q + 1]]
        if len(q):
            padded = np.append(points, [0, 0, 0])
            stop = np.append(begin, [True, True])
            a, b = padded[q + 1], padded[q + 2]
            two = ~stop[q + 2] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
            one = np.isin(a, (115, 116, 109, 100))
            for hit, k in ((q[one], 2), (q[two & ~one], 3)):
                starts[hit + 1] = False
                rest = hit + k
                rest = rest[rest < n]
                rest = rest[~begin[rest]]
                inside = (kind[rest] == 1) & (kind[rest - 1] == 1)
                starts[rest[inside]] = True
        return np.flatnonzero(starts)

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has) of consecutive texts."""
        raw = data.tobytes()
        if self.split and not any(t in raw for t in self.added):
            return self._cached(raw, data, offsets)
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        special = [i for i, t in enumerate(texts) if not self.split or any(x in t for x in self.added)]
        ids: list = [None] * len(texts)
        for i, found in zip(special, self._whole([texts[i] for i in special]), strict=True):
            ids[i] = np.array(found, np.int32)
        rest = [i for i, x in enumerate(ids) if x is None]
        if rest:
            own = b"".join(texts[i] for i in rest)
            flat, per = self._cached(own, np.frombuffer(own, np.uint8), np.cumsum([0, *(len(texts[i]) for i in rest)]))
            for i, found in zip(rest, np.split(flat, np.cumsum(per)[:-1]), strict=True):
                ids[i] = found
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _new(self, whole: str, points: np.ndarray, b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each has) of the pre-tokens ``whole[b:e]``."""
        plain = np.zeros(len(b), bool)
        if self.join:
            plain = (points[b] == 32) & (e - b > 1)
            plain[plain] = self.kind[points[b[plain] + 1]] == 1
        sizes, parts, order = np.zeros(len(b), np.int64), [], []
        own = np.flatnonzero(plain)
        if len(own):
            n = e[own] - b[own]
            ends = np.cumsum(n)
            text = points[np.arange(ends[-1]) + np.repeat(b[own] - (ends - n), n)].tobytes().decode("utf-32-le")
            cuts = [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), int(ends[-1])]
            found = self.tokenizer.encode_batch_fast([text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, np.int32) for x in found])
            first = np.flatnonzero(self.blank[ids])
            if len(first) == len(own) and first[0] == 0:
                sizes[own] = np.diff(np.r_[first, len(ids)])
                parts.append(ids)
                order.append(own)
            else:  # a tokenizer whose blanks don't stay apart
                self.join, plain = False, np.zeros(len(b), bool)
        rest = np.flatnonzero(~plain)
        if len(rest):
            made = [x.ids for x in self.tokenizer.encode_batch_fast([whole[i:j] for i, j in zip(b[rest].tolist(), e[rest].tolist(), strict=True)], add_special_tokens=False)]
            sizes[rest] = [len(x) for x in made]
            parts.append(np.array([x for y in made for x in y], np.int32))
            order.append(rest)
        # Back into the order of the pre-tokens.
        order_ = np.concatenate(order)
        flat = np.concatenate(parts)
        begun = np.zeros(len(b), np.int64)
        begun[order_] = np.cumsum(sizes[order_]) - sizes[order_]
        ends = np.cumsum(sizes)
        return flat[np.arange(len(flat)) + np.repeat(begun - (ends - sizes), sizes)], sizes

    def _cached(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without added tokens, by pre-tokens."""
        whole = raw.decode()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if n != len(data):
            offsets = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        start = self._starts(points, offsets)
        end = np.append(start[1:], n)
        p, q = common._power(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(common.mix(points.astype(np.uint64) + np.uint64(99)) * p[:n], out=total[1:])
        h = common.mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
        h[h == 0] = 1
        if self.known.used > CACHE:
            self._forget()
        slot = self.known.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            b, e = start[missing[first]], end[missing[first]]
            base = self.known.used
            ids, sizes = self._new(whole, points, b, e)
            while base + len(new) > len(self.n):
                self.at, self.n = np.concatenate([self.at, self.at]), np.concatenate([self.n, self.n])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat])
            self.n[base : base + len(new)] = sizes
            self.at[base : base + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.known.add(new, np.arange(base, base + len(new), dtype=np.int32))
            slot[missing] = base + which
        counts = self.n[slot].astype(np.int64)
        ends = np.cumsum(counts)
        out = self.flat[np.arange(ends[-1]) + np.repeat(self.at[slot] - (ends - counts), counts)]
        per = np.diff(np.r_[0, ends][np.searchsorted(start, offsets)])
        return out, per


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder for a worker process and definition, whose cache goes on from task to task."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; the manifest: file, path, docs, tokens, groups, first_place.

    ``tokenizer`` is the path of a definition, which the driver reads. Files follow ranges of doc_id.
    """
    spark = common.session(docs)
    common.bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = narrow.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(definition.value)
        path = f"{folder}/tokens-{part:06d}.parquet"
        docs_, tokens, groups = 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held_tokens = held_docs = 0
        first = next(batches, None)
        if first is None:
            return

        def every():
            yield first
            yield from batches

        def flush(writer) -> None:
            nonlocal held, held_tokens, held_docs, tokens, docs_, groups
            if not held:
                return
            ids = pa.concat_arrays([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            flat = np.concatenate([x[2] for x in held])
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))
            local = pa.array(tokens + ends - n, pa.int64())
            writer.write_table(pa.Table.from_arrays([ids, local, pa.array(n, pa.int32()), lists], schema=SCHEMA), row_group_size=len(n))
            tokens, docs_, groups = tokens + int(ends[-1]), docs_ + len(n), groups + 1
            held, held_tokens, held_docs = [], 0, 0

        with common.AtomicFile(path) as out, pq.ParquetWriter(
            out, SCHEMA, version="2.6", compression="zstd", compression_level=1, use_dictionary=["ids.list.element"], dictionary_pagesize_limit=1 << 20,
            column_encoding={"doc_id": "DELTA_BINARY_PACKED", "local_start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, data_page_size=PAGE_BYTES, write_page_index=True, write_statistics=True,
        ) as writer:
            for batch in every():
                for i, j, data, offsets in common.text_slices(batch.column(1), 1 << 20):
                    ids, per = encode.encode(data, offsets)
                    ends = np.cumsum(per)
                    flat = np.full(len(ids) + len(per), end_id, np.int32)
                    keep = np.ones(len(flat), bool)
                    keep[ends + np.arange(len(per))] = False
                    flat[keep] = ids
                    held.append((batch.column(0).slice(i, j - i), per + 1, flat))
                    held_tokens, held_docs = held_tokens + len(flat), held_docs + j - i
                    if held_tokens >= GROUP_TOKENS or held_docs >= GROUP_DOCS:
                        flush(writer)
            flush(writer)
        row = [[part], [path], [docs_], [tokens], [groups]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["file", "path", "docs", "tokens", "groups"])

    files = common.cut(ordered.mapInArrow(run, "file int, path string, docs long, tokens long, groups int"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_place", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids and ids_crc32 of the documents in the manifest's files.

    A task reads row groups; without ``ids`` their column chunks aren't touched.
    """
    spark = common.session(manifest)
    groups = manifest.select("path", "first_place", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    groups = groups.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "group")
    columns = ["doc_id", "local_start", "n_tokens"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, group in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, plain = common.filesystem(path)
                with fs.open_input_file(plain) as f:
                    t = pq.ParquetFile(f).read_row_group(group, columns=columns).combine_chunks()
                start = pa.array(t.column("local_start").to_numpy() + base, pa.int64())
                out = [t.column("doc_id").combine_chunks(), start, t.column("n_tokens").combine_chunks().cast(pa.int64())]
                if ids:
                    lists = t.column("ids").combine_chunks()
                    flat, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
                    out.append(pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()))
                out = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens"] + ["ids_crc32"] * ids)

    return groups.mapInArrow(run, "doc_id long, start long, n_tokens long" + ", ids_crc32 long" * ids)


def tokenize_documents(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the ids of every row of ``docs`` (doc_id, text; other columns are ignored) and read the files back.

    Null and empty texts have the end id alone. Repeated doc_ids stand side by side, ordered by text; null ones come
    first. An empty table gives no files and no rows.
    """
    folder = folder or common.new_folder(common.session(docs), "tokens")
    return read(write(docs, tokenizer, folder))
