"""URL filtering by the ratio of two character language models, behind a table of host and path rules.

URLs that an allow or block rule decides train an accepting and a rejecting model: variable-order Markov models over
bytes, each order smoothed towards the next shorter one. The score is the difference of log-likelihoods a byte, and the
threshold is the one with the best balanced accuracy on a fifth of the ruled URLs, which the models don't see. Counts
come from all other ruled URLs; they are exact and stay in a distributed table with a row for each distinct gram, which
grows with the input. URLs are scored in blocks of about BLOCK_BYTES: the distinct grams of a block are joined with the
table, so a task holds the counts of its block's grams only and no model is sent.

Defined results: a null URL, or one without ://, has empty host and path and no rule; the method judges its bytes, and
one without bytes scores 0; repeated rows give a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, passes, table, tidy

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 6
#: Bytes of URLs that one block holds, about (a single longer URL is taken whole).
BLOCK_BYTES = 1 << 19
#: Weight of the shorter context, in observations.
PRIOR = 4.0
BINS, REACH = 800, 4.0


def with_parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (allow, block or null)."""
    rest = F.when(F.contains("url", F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)"))
    out = pages.select("page_id", "url", rest.alias("rest"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = out.withColumn("raw", F.coalesce(F.regexp_extract("rest", r"^[^/?#]*+", 0), F.lit("")))
    after = F.expr("substring(rest, length(raw) + 1)")
    out = out.withColumn("path", F.coalesce(F.regexp_extract(after, r"^[^?#]*+", 0), F.lit(""))).withColumn("host", F.translate("raw", upper, lower))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits: Column = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), ruled.alias("ruled"))


def grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url of each byte, place of each byte in its url, key of the gram of 1 to ORDER bytes that ends there).

    A key is exact: the gram's length, then its bytes. It means nothing where the place is smaller than the order.
    """
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(len(buf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, h = np.zeros((ORDER, len(buf)), np.int64), np.zeros(len(buf), np.int64)
    for k in range(min(ORDER, len(buf))):
        h[k:] |= buf[: len(buf) - k] << (8 * k)
        out[k] = h | ((k + 1) << (8 * ORDER))
    return owner, place, out


def blocks(parts: DataFrame) -> DataFrame:
    """parts with a block: stretches of a partition's rows whose URLs have about BLOCK_BYTES."""
    from pyspark import TaskContext

    @tidy
    def run(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            said = []
            for n in pc.fill_null(pc.binary_length(batch.column("url")), 0).to_pylist():
                if size and size + n > BLOCK_BYTES:
                    block, size = block + 1, 0
                said.append(block)
                size += n
            yield batch.append_column("block", pa.array(said, pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes) + ", block long"
    return parts.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch):
    """Runs of rows of about BLOCK_BYTES of URLs, so that a long batch isn't counted in one go."""
    return passes(batch, "url", BLOCK_BYTES)


@tidy
def _count(batches):
    for batch in batches:
        for part in _slices(batch):
            allow = np.array([r == "allow" for r in part.column("ruled").to_pylist()], bool)
            owner, place, at = grams(part.column("url").to_pylist())
            keys = np.concatenate([np.zeros(len(owner), np.int64), *(at[k][place >= k] for k in range(ORDER))])
            good = np.concatenate([allow[owner], *(allow[owner[place >= k]] for k in range(ORDER))])
            keys, of = np.unique(keys, return_inverse=True)
            n = [np.bincount(of[side], minlength=len(keys)).astype(np.int64) for side in (good, ~good)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x) for x in n)], ["gram", "a", "b"])


@tidy
def _asked(batches):
    """The distinct grams of the URLs of a block, and the empty gram."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for s, e in zip(edges, [*edges[1:], len(block)], strict=True):
            _, place, at = grams(batch.column("url").slice(s, e - s).to_pylist())
            keys = np.unique(np.concatenate([np.zeros(1, np.int64), *(at[k][place >= k] for k in range(ORDER))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block[s])), pa.array(keys)], ["block", "gram"])


def score(keys: np.ndarray, counts: np.ndarray, urls: list[str | None]) -> np.ndarray:
    """Log-likelihood a byte under the accepting model less that under the rejecting one.

    keys: sorted, of all grams of the urls that the models know, the empty one (all bytes) among them; counts: of both.
    """
    owner, place, at = grams(urls)
    if not len(owner) or not len(keys):
        return np.zeros(len(urls))
    where = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    known = keys[where] == at
    diff = np.zeros(len(owner))
    for s, sign in ((0, 1.0), (1, -1.0)):
        seen = np.where(known, counts[s][where], 0)
        p = np.full(len(owner), 1 / 256)
        for k in range(ORDER):
            n = seen[k]
            context = np.full(len(owner), counts[s][0]) if k == 0 else np.concatenate([[0], seen[k - 1][:-1]])
            p = np.where(place >= k, (n + PRIOR * p) / (np.maximum(context, n) + PRIOR), p)
        diff += sign * np.log(p)
    return np.bincount(owner, diff, len(urls)) / np.maximum(np.bincount(owner, minlength=len(urls)), 1)


def _held_out() -> Column:
    return F.crc32(F.encode(F.col("page_id").cast("string"), "UTF-8")) % 5 == 0


def fit(parts: DataFrame) -> DataFrame:
    """(gram, a, b): how often each gram stands in allowed and in blocked URLs, of all that a rule decides but a fifth."""
    ruled = parts.where("ruled is not null and url is not null").where(~F.coalesce(_held_out(), F.lit(False)))
    rows = ruled.select("url", "ruled").mapInArrow(_count, "gram long, a long, b long")
    return rows.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def scored(parts: DataFrame, model: DataFrame) -> DataFrame:
    """parts (with their blocks) and the score: each block meets the counts of its own grams only."""
    asked = parts.select("block", "url").mapInArrow(_asked, "block long, gram long").distinct()
    counts = asked.join(model, "gram").select("block", "gram", "a", "b")
    names = [c for c in parts.columns if c != "block"]

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("gram").to_numpy()
        order = np.argsort(keys)
        both = np.stack([right.column(c).to_numpy()[order] for c in "ab"])
        said = [score(keys[order], both, part.column("url").to_pylist()) for batch in left.to_batches() for part in _slices(batch)]
        return left.select(names).append_column("score", pa.array(np.concatenate([np.zeros(0), *said])))

    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes if c != "block") + ", score double"
    return parts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(judge, schema)


def threshold(judged: DataFrame, model: DataFrame) -> float:
    """The score with the best balanced accuracy on the held-out ruled URLs."""
    whole = model.where("gram = 0").first()
    if not whole or not whole["a"] or not whole["b"]:
        return -np.inf if not whole or not whole["b"] else np.inf
    edges = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))))).cast("int")
    held = judged.where("ruled is not null and url is not null").where(_held_out())
    hist = np.zeros((2, BINS))
    for r in held.groupBy(edges.alias("bin"), "ruled").agg(F.count("*").alias("n")).collect():
        hist[int(r["ruled"] == "block"), r["bin"]] += r["n"]
    good = hist[0].sum() - np.concatenate([[0], np.cumsum(hist[0])])
    bad = np.concatenate([[0], np.cumsum(hist[1])])
    balanced = good / max(hist[0].sum(), 1) + bad / max(hist[1].sum(), 1)
    best = np.flatnonzero(balanced == balanced.max())
    return float(best[np.argmin(abs(best - BINS / 2))] * (2 * REACH) / BINS - REACH)


def filter_urls(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages(page_id, url)."""
    scratch = Scratch(spark, "urls")
    parts = scratch.table(blocks(with_parts(pages, rules)), "parts")
    model = scratch.table(fit(parts), "model")
    judged = scratch.table(scored(parts, model), "judged")
    method = F.when(F.col("score") >= F.lit(threshold(judged, model)), "allow").otherwise("block")
    scratch.drop("parts")
    scratch.drop("model")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")


def op5_markov_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, table(spark, sf_dir, "pages"))
