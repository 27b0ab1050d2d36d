"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of all runs of SEED words in a window of `length` words, the one with the least hash. Equal
windows choose the same seed at the same place, so every repeat of `length` words shares an anchor. An anchor is
extended both ways at once by a hash of its context, the words that any window around it can reach. Where the whole
context occurs in a smaller document, all its windows do: inside long repeats nothing else is needed. Only the first
document of each context of an anchor with several contexts (the ends of repeats) is looked at window by window. The
union of what was found is the maximal repeats of at least `length` words.

The smallest document of an anchor, a context or a window is found with partial aggregates, so a passage that a third
of all documents hold is never gathered in one task. Documents whose words all equal those of a smaller one are removed
whole.

Defined results: a null text has no words; texts of fewer than `length` words keep all; a null doc_id is compared with
nothing; repeated rows of a doc_id are the same document (texts of one doc_id must be equal); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, ints, mix, only_ids, passes, signed, table, tidy

_U = np.uint64
_Q = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))


class Ranges:
    """Hashes of any ranges of words, from sums of powers (the base is odd, so it has an inverse modulo 2**64)."""

    def __init__(self, words: Words):
        n = len(words.starts)
        self.sums, self.down = [], []
        for h, q in zip(words.hash, _Q, strict=False):
            up = np.full(n + 1, q, np.uint64)
            up[0] = 1
            up = np.multiply.accumulate(up)
            down = np.full(n + 1, _U(pow(int(q), -1, 1 << 64)), np.uint64)
            down[0] = 1
            self.down.append(np.multiply.accumulate(down))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)]))

    def hash(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        return mix((self.sums[k][end] - self.sums[k][start]) * self.down[k][start])


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of h[i] to h[i + width - 1], the leftmost of equals."""
    best, at, span = h, np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        n = len(best) - step
        left = best[:n] <= best[step:]
        at = np.where(left, at[:n], at[step:])
        best = np.where(left, best[:n], best[step:])
        span += step
    return at


@tidy
def _meta(batches):
    """n_words, sha256 of the words joined by a space, and a digest of the words."""
    for batch in batches:
        for part in passes(batch):
            words = Words(part.column("text"), fold=False, wide=True)
            ranges = Ranges(words)
            n = np.diff(words.first)
            whole = [signed(ranges.hash(words.first[:-1], words.first[1:], k)) for k in range(2)]
            shas = [hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).hexdigest() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ints(n), pa.array(shas, pa.string()), *whole], ["doc_id", "n_words", "sha", "d1", "d2"])


def _anchors(length: int, seed: int):
    reach = length - seed

    @tidy
    def run(batches):
        for batch in batches:
            for part in passes(batch):
                words = Words(part.column("text"), fold=False, wide=True)
                if len(words.starts) < length:
                    continue
                windows = np.flatnonzero(words.inside(length))
                at = np.unique(winnow(words.windows(seed), reach + 1)[windows])
                doc = words.doc[at]
                start, end = np.maximum(at - reach, words.first[doc]), np.minimum(at + length, words.first[doc + 1])
                ranges = Ranges(words)
                shape = ((at - start) * 1000 + (end - at)).astype(np.uint64)
                context = [mix(ranges.hash(start, end, k) ^ mix(shape)) for k in range(2)]
                ids = part.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([signed(ranges.hash(at, at + seed, 0)), *map(signed, context), ids, ints(at - words.first[doc])], ["anchor", "c1", "c2", "doc", "pos"])

    return run


def _windows(length: int, seed: int):
    """Hashes of all windows that hold one of the given anchors."""
    reach = length - seed

    @tidy
    def run(batches):
        for batch in batches:
            for part in passes(batch):
                words = Words(part.column("text"), fold=False, wide=True)
                want = np.zeros(len(words.starts) + 1, np.int64)
                for k, places in enumerate(part.column("places")):
                    p = words.first[k] + places.values.to_numpy()
                    lo, hi = np.maximum(p - reach, words.first[k]), np.minimum(p, words.first[k + 1] - length)
                    np.add.at(want, lo, 1)
                    np.add.at(want, hi + 1, -1)
                at = np.flatnonzero(np.cumsum(want)[:-1] > 0)
                ranges = Ranges(words)
                doc = words.doc[at]
                found = [signed(ranges.hash(at, at + length, k)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*found, part.column("doc_id").take(pa.array(doc)), ints(at - words.first[doc])], ["w1", "w2", "doc", "pos"])

    return run


@tidy
def _cut(batches):
    """What is left of each text without its marked ranges of words."""
    for batch in batches:
        ids, removed, shas = [], [], []
        for doc, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("marks"), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(words) + 1, np.int64)
            starts, ends = (marks.values.field(k).to_numpy() for k in range(2))
            np.add.at(edge, np.clip(starts, 0, len(words)), 1)
            np.add.at(edge, np.clip(ends, 0, len(words)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            ids.append(doc)
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_removed", "kept"])


def repeated_words(spark: SparkSession, docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """(meta, marks(doc, s, e) of words that also stand in a smaller document, texts of marked documents, scratch)."""
    scratch, seed = Scratch(spark, "repeats"), length // 2
    docs = docs.select("doc_id", "text")
    meta = scratch.table(docs.mapInArrow(_meta, "doc_id long, n_words long, sha string, d1 long, d2 long"), "meta")
    least = meta.where(F.col("n_words") >= length).groupBy("n_words", "d1", "d2").agg(F.min("doc_id").alias("first_doc"))
    least = scratch.table(least, "least")
    meta = scratch.table(meta.join(least, ["n_words", "d1", "d2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False))), "copies")

    anchors = docs.where("doc_id is not null").mapInArrow(_anchors(length, seed), "anchor long, c1 long, c2 long, doc long, pos long")
    anchors = scratch.table(anchors, "anchors")
    several = anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    # a table of its own: adaptive execution can then split a common anchor
    shared = scratch.table(anchors.join(scratch.table(several, "several"), "anchor"), "shared")
    scratch.drop("anchors")
    scratch.drop("several")
    first = shared.groupBy("c1", "c2").agg(F.min("doc").alias("first_doc"), F.first("anchor").alias("of"))
    first = scratch.table(first, "contexts")
    mixed = first.groupBy("of").agg(F.count("*").alias("n")).where("n > 1").select(F.col("of").alias("anchor"))
    mixed = scratch.table(mixed, "mixed")
    placed = shared.join(first.select("c1", "c2", "first_doc"), ["c1", "c2"])
    reach = length - seed
    full = placed.where("doc > first_doc").select("doc", F.greatest(F.lit(0), F.col("pos") - reach).alias("s"), (F.col("pos") + length).alias("e"))
    full = scratch.table(full.join(meta.where("copy").select(F.col("doc_id").alias("doc")).distinct(), "doc", "left_anti"), "full")
    ends = scratch.table(placed.where("doc = first_doc").join(mixed, "anchor").select("doc", "pos").distinct(), "ends")

    touched = full.select(F.col("doc").alias("doc_id")).union(ends.select("doc")).distinct()
    texts = scratch.table(only_ids(spark, docs, touched).dropDuplicates(["doc_id"]), "texts")
    places = ends.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("pos").alias("places"))
    windows = texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_windows(length, seed), "w1 long, w2 long, doc long, pos long")
    windows = scratch.table(windows, "windows")
    smallest = windows.groupBy("w1", "w2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("w1", "w2", "a")
    single = windows.join(smallest, ["w1", "w2"]).where("doc > a").select("doc", F.col("pos").alias("s"), (F.col("pos") + length).alias("e"))
    marks = scratch.table(full.union(single), "marks")
    scratch.drop("windows")
    return meta, marks, texts, scratch


def op4_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta, marks, texts, scratch = repeated_words(spark, table(spark, sf_dir, "documents"))
    by_doc = marks.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    cut = texts.join(by_doc, "doc_id").select("doc_id", "text", "marks").mapInArrow(_cut, "doc_id long, n_removed long, kept string")
    none = hashlib.sha256(b"").hexdigest()
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("kept", "sha"))
    return meta.join(scratch.table(cut, "cut"), "doc_id", "left").select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
