"""Helpers that the operators share: shared scratch tables, whole-text word scanning in numpy, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word; all other bytes belong to words.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
#: Bytes of text that one numpy pass holds at most (a single longer text is still taken whole).
PASS_BYTES = 1 << 19

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one is made only where none is named, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spanforge-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def give_back() -> None:
    """Return what this Python worker holds no more to the system: workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(run):
    """run (batches to batches), after which the worker gives its memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Rows of an Arrow batch at most while tables are written: documents are long, and the JVM holds batches outside its heap.
BATCH_ROWS = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Queries that run inside send Python at most BATCH_ROWS rows at a time; the session's own setting then returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), BATCH_ROWS) if int(old) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; the shuffle files of what made it can then go."""
        path = f"{self.base}/{name}"
        schema = df.schema
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of an id filter at most; what it lets pass beyond its ids is sorted out by the exact join that follows.
FILTER_BITS = 1 << 26


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15)) & _U(bits - 1)).astype(np.int64)


def id_filter(spark: SparkSession, ids: DataFrame) -> np.ndarray:
    """A bit map of the ids (one column of longs), of bounded size for any number of them.

    With it a task drops most rows that a semi-join would drop, before their texts are shuffled.
    """
    n = ids.count()
    bits = min(FILTER_BITS, max(1 << 10, 1 << int(16 * n).bit_length()))

    @tidy
    def run(batches):
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits)
            word, of = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, of, _U(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), signed(value)], ["word", "value"])

    words = ids.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["value"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_filter(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids, len(bitmap) << 6)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1


def only_ids(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is one of ids (doc_id): the filter in each task, then the exact semi-join. Null ids go."""
    sent = spark.sparkContext.broadcast(id_filter(spark, ids.select("doc_id")))

    @tidy
    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            if batch.num_rows:
                yield batch.filter(pa.array(in_filter(sent.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))

    return docs.mapInArrow(run, docs.schema).join(ids, "doc_id", "left_semi")


def without_ids(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is none of ids (doc_id), null ids included. Only rows that the filter lets pass are shuffled."""
    sent = spark.sparkContext.broadcast(id_filter(spark, ids.select("doc_id")))

    def picked(inside: bool) -> DataFrame:
        @tidy
        def run(batches):
            for batch in batches:
                column = batch.column("doc_id")
                found = in_filter(sent.value, pc.fill_null(column, 0).to_numpy(zero_copy_only=False)) & pc.is_valid(column).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found if inside else ~found))

        return docs.mapInArrow(run, docs.schema)

    return picked(False).union(picked(True).join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- numpy over whole texts

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * _U(2) + _U(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_P = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_Q = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a sum reaches every bit of the result."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts, found in one numpy pass over their UTF-8 bytes.

    starts, ends: byte places of the words in buf; first: index of each text's first word, one more entry at the end;
    hash: one 64-bit hash for each word (two with wide=True). fold=True lower-cases A-Z first. Null texts have no words.
    breaks: which bytes end a word, white space if None.
    """

    def __init__(self, texts: pa.Array, fold: bool, wide: bool = False, breaks: np.ndarray | None = None):
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        n = len(texts)
        raw = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        base = int(raw[0])
        self.buf = np.frombuffer(data, np.uint8, int(raw[-1]) - base, base) if data is not None and raw[-1] > base else np.zeros(0, np.uint8)
        at = raw - base
        self.n_texts = n
        ws = (_IS_WS if breaks is None else breaks)[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[at] = True  # a word never crosses from one text into the next
        before = np.ones(len(self.buf), bool)
        before[1:] = ws[:-1]
        self.starts = np.flatnonzero(~ws & (before | edge[:-1]))
        after = np.ones(len(self.buf), bool)
        after[:-1] = ws[1:]
        self.ends = np.flatnonzero(~ws & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, at)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = [self._hash(ws, k, fold) for k in range(2 if wide else 1)]

    def _hash(self, ws: np.ndarray, k: int, fold: bool) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = np.diff(np.append(self.starts, len(self.buf)))
        place = np.arange(self.starts[0], len(self.buf)) - np.repeat(self.starts, sizes)
        powers = _powers(_P[k], int((self.ends - self.starts).max()) + 1)
        by = _BYTE[k][_FOLD] if fold else _BYTE[k]
        part = self.buf[self.starts[0] :]
        value = by[part] * powers[np.minimum(place, len(powers) - 1)]
        value[ws[self.starts[0] :]] = 0
        return mix(np.add.reduceat(value, self.starts - self.starts[0]) + (self.ends - self.starts).astype(np.uint64))

    def windows(self, size: int, k: int = 0) -> np.ndarray:
        """A hash of the words i to i+size-1 for each i; those that cross into another text mean nothing."""
        h, n = self.hash[k], len(self.hash[k]) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, power, done, span, step = np.zeros(n, np.uint64), np.ones(1, np.uint64), 0, h, 1
        grow = np.array([_Q[k]])
        rest = size
        while rest:  # by doubling: spans of 1, 2, 4, ... words
            if rest & 1:
                out += power * span[done : done + n]
                done += step
                power = power * grow
            rest >>= 1
            if rest:
                span = span[: len(span) - step] + grow * span[step:]
                grow, step = grow * grow, step * 2
        return mix(out)

    def inside(self, size: int) -> np.ndarray:
        """Whether the window of so many words from i stays in its text."""
        n = len(self.starts) - size + 1
        return self.doc[:n] == self.doc[size - 1 :] if n > 0 else np.zeros(0, bool)


def passes(batch: pa.RecordBatch, column: str = "text", most: int = PASS_BYTES):
    """Slices of an Arrow batch whose texts fit one numpy pass."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end


def ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64, copy=False))


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


# ---------------------------------------------------------------- connected components


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of an edge (a, b).

    Alternating large-star and small-star rounds; each is an aggregate and a join, so no group of neighbours is held in
    a task, and each round's links are a table in the shared folder.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links-0")
    for k in range(1, 200):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", F.col("m").alias("v")))
        new = scratch.table(small.where("u > v").distinct(), f"links-{k}")
        says = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum("v")).first()
        same = says(new) == says(now)
        scratch.drop(f"links-{k - 1}")
        now = new
        if same:
            break
    up = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().join(up.select(F.col("u").alias("node")), "node", "left_anti")
    return up.select(F.col("u").alias("node"), "component").union(roots.select("node", F.col("node").alias("component")))
