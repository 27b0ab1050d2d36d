"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased with runs of white space as one space. An item of L code points may differ in
k = floor(RATE * L) edits; it is cut into k + 1 pieces, so an occurrence within the budget holds a piece unchanged. One
Aho-Corasick automaton finds all pieces in a text; around each hit Myers' bit-parallel algorithm finds the least edit
distance of the whole item. Items whose budget is 0 must stand between word ends.

The items are sent to tasks in blocks of about BLOCK_CHARS code points, one pass over the documents for each, and the
driver holds one block at a time. A found end is extended back to the true start by the same algorithm on the reversed
strings.

Defined results: null and empty texts match nothing; null and empty items are skipped; an item whose id is null is
matched like any other and reported with a null id; repeated items and repeated rows give their matches each; of
occurrences of one item with equal distance the first counts; empty tables give no rows; extra columns, of any name,
are ignored by matches_of() and stay in without_matches().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table, tidy

RATE = 0.06
BLOCK_CHARS = 4_000_000

NAMES = ("item_id", "distance", "budget", "start", "end")


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, masks: dict[str, int], text: str, anchored: bool = False) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of text, the first end of such a substring).

    anchored: the substring starts where the text does.
    """
    m = len(pattern)
    last, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best, where = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & last) - bool(mh & last)
        ph = (ph << 1 | anchored) & full  # unless anchored, an occurrence may start anywhere
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    cuts = [len(pattern) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item, raw in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            if pattern := plain(raw):
                budget = int(rate * len(pattern))
                for offset, piece in pieces(pattern, budget):
                    hits.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item, pattern, budget, masks_of(pattern)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in hits.items():
            self.automaton.add_word(piece, (len(piece), found))
        if hits:
            self.automaton.make_automaton()
        self.some = bool(hits)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of each item's best occurrence; places in the folded text."""
        text = plain(text)
        if not self.some or not text:
            return []
        near: dict[int, list[int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for k, offset in found:
                near.setdefault(k, []).append(end + 1 - size - offset)
        out = []
        for k, starts in sorted(near.items()):
            item, pattern, budget, masks = self.items[k]
            m, best = len(pattern), (budget + 1, 0, 0)
            windows: list[list[int]] = []
            for s in sorted(set(starts)):
                if budget == 0:
                    e = s + m
                    if s >= 0 and text[s:e] == pattern and (s == 0 or text[s - 1] == " ") and (e == len(text) or text[e] == " "):
                        best = (0, s, e)
                        break
                    continue
                lo, hi = max(0, s - budget), min(len(text), s + m + 2 * budget)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                distance, where = myers(pattern, masks, text[lo:hi])
                if distance < best[0]:
                    best = (distance, lo, lo + where)
            if 0 < budget >= best[0]:  # from the end back to the start
                reach = text[max(best[1], best[2] - m - budget) : best[2]]
                back = myers(pattern[::-1], masks_of(pattern[::-1]), reach[::-1], anchored=True)[1]
                best = (best[0], best[2] - back, best[2])
            if best[0] <= budget:
                out.append((item, best[0], budget, best[1], best[2]))
        return out


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """All items, in blocks by a hash of their id and text; one block is fetched at a time."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def matches_of(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end) of docs(doc_id, text); places are those in the folded text."""
    docs = docs.select("doc_id", "text")

    def searched(items: list[tuple[int | None, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)  # a block, of bounded size

        @tidy
        def run(batches):
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                ids, found = [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    here = matcher.matches(text.as_py())
                    ids += [doc] * len(here)
                    found += here
                columns = list(zip(*found, strict=True)) or [[]] * len(NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *NAMES])

        return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in NAMES)]))

    return reduce(DataFrame.union, map(searched, blocks_of(benchmark)))


def without_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs that hold no item within its edit budget. From the second block of items on, what is left is a table."""
    scratch, out = Scratch(spark, "clean"), docs
    for k, items in enumerate(blocks_of(benchmark)):
        sent = spark.sparkContext.broadcast(items)

        @tidy
        def run(batches, sent=sent):
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t.as_py()) for t in batch.column("text")], pa.bool_()))

        out = (scratch.table(out, f"block-{k}") if k else out).mapInArrow(run, docs.schema)
    return out


def op7_pigeonhole_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches_of(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
