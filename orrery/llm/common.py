"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Rows of one Arrow batch handed to Python; texts may be very long.
BATCH_ROWS = 1000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory is bounded by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- files in the shared folder, from Python -------------------------------------------------


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; plain paths and file: are local."""
    from pyarrow import fs

    if m := re.match(r"file:/*(/.*)", uri):
        return fs.LocalFileSystem(), m[1]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """Write beside the target, move it into place on success: a repeated or speculative task leaves one whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.tmp, self.path)
        else:
            self.fs.delete_file(self.tmp)


# --- words as 64-bit hashes, many texts at once ----------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII letters to lower case, other bytes as they are.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED = _BYTE[_FOLD]
#: Not part of an alphanumeric word: ASCII other than letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) <= n:
        for k, base in (("p", _P), ("q", _PINV)):
            x = np.full(max(n + 1, 1 << 20), base)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words of consecutive texts.

    ``data`` holds the texts' UTF-8 bytes end to end and ``offsets`` where each begins; ``separator`` marks the bytes
    between words. ``start``, ``end``: each word's bytes; ``doc``: first word of each text (one more entry at the end);
    ``hash``: 64 bits of each lower-cased word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE):
        n = len(data)
        gap = np.empty(n + 1, bool)
        gap[0] = True
        np.take(separator, data, out=gap[1:])
        inside = ~gap[1:]
        first = gap[:-1].copy()
        at = offsets[:-1]
        first[at[at < n]] = True
        self.start = np.flatnonzero(inside & first)
        last = np.empty(n, bool)
        if n:
            last[:-1] = first[1:] | gap[2:]
            last[-1] = True
        self.end = np.flatnonzero(inside & last) + 1
        p, q = _power(n)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_FOLDED[data] * p[:n], out=self._sum[1:])
        self._q = q
        self.hash = self.span_hash(self.start, self.end)
        self.doc = np.searchsorted(self.start, offsets)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._q[start] + (end - start).astype(np.uint64))


def hash_of(words: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives these single words (ASCII letters folded)."""
    data = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, data)])
    every = np.frombuffer(b"".join(data), np.uint8)
    w = Words(every, offsets, np.zeros(256, bool))
    return w.hash


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether they lie in one text)."""
    h = words.hash
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[i : n - k + 1 + i])
    whole = np.ones(n - k + 1, bool)
    for b in words.doc[1:-1]:
        whole[max(0, b - k + 1) : b] = False
    return out, whole


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a string column, in pieces of about ``most`` bytes; nulls are empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, every[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# --- connected components ----------------------------------------------------------------------


#: Edges that one task joins at once: 16 MB of ids.
TASK_EDGES = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id reachable from each) of the edges from ``a`` to ``b``."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    part = np.arange(len(ids))
    while len(x):
        u, v = part[x], part[y]
        apart = u != v
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(part, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := part[part], part):
            part = up
    return ids, ids[part]


def _joined(edges: DataFrame, most: int, roots: bool) -> DataFrame:
    """(id, component) within each ``most`` edges (a, b) of a task, where an id is not its own component or ``roots`` is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ids, least = least_reachable(*np.concatenate(held, 1))
            keep = roots | (ids != least)
            ids, least = ids[keep], least[keep]
            for i in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (ids, least)], names=["id", "component"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([np.asarray(c) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= most:
                yield from join(held)
                held = []
        if held:
            yield from join(held)

    return edges.select("a", "b").mapInArrow(run, "id long, component long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the smallest id reachable.

    Each task first replaces its edges by those from every id to the least of its part, which are never more. Up to
    TASK_EDGES that are left are joined by one task. Of more, contraction by random priorities makes fewer: each round every
    vertex joins its neighbour of least priority, edges are renamed and loops dropped, so that the number of vertices falls
    by a constant factor. Each round is checkpointed. The driver gets counts only, but also keeps what it knows of every
    job, stage and task; so the rounds are as few as can be.
    """
    most = TASK_EDGES
    stars = lambda e: cut(_joined(e, most, False).select(F.col("component").alias("a"), F.col("id").alias("b")))
    e = stars(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")))
    members = None
    for k in range(most_rounds):
        if e.count() <= most:
            break
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
        parent = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.when(F.col("m") < rank("a"), F.col("m.v")).otherwise(F.col("a")).alias("p"))
        parent = cut(parent)
        left, right = parent.withColumnsRenamed({"v": "a", "p": "pa"}), parent.withColumnsRenamed({"v": "b", "p": "pb"})
        if members is None:
            members = parent.withColumnsRenamed({"v": "id", "p": "root"})
        else:
            up = parent.withColumnsRenamed({"v": "root", "p": "up"})
            members = members.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        members = cut(members)
        e = stars(e.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not converge")
    last = cut(_joined(e.coalesce(1), most + 1, True))
    if members is None:
        return last
    members = members.join(last.withColumnsRenamed({"id": "root", "component": "up"}), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    members = cut(members)
    least = members.groupBy("root").agg(F.min("id").alias("component"))
    return members.join(least, "root").select("id", "component")
