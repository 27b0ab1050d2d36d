"""Canonical exact digests: Unicode normalisation, case and white-space folding, a wide xxhash, and byte comparison
inside equal buckets.

A fingerprint is the 128-bit xxh3 of the canonical text in hex. Where two canonical texts share it but differ in a byte,
all members of that bucket get their sha256 appended, so fingerprints are equal if and only if canonical texts are.
Likeness of two exact digests is 1 or 0.

Defined results: null is the empty text; repeated rows give a row each (rows of one doc_id are ordered by a hash of
their text); a null doc_id sorts first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_filter, in_filter, partitions, table, tidy


def canonical(text: str) -> str:
    """NFKC, case-folded, NFKC again (folding can break it), every run of white space one space, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def _digests(text: str) -> tuple[bytes, bytes]:
    canon = canonical(text).encode("utf-8", "surrogatepass")
    return canon, xxhash.xxh3_128_digest(canon)


def by_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in ranges of doc_id (columns part, halo), each followed by the first row of the next range.

    The bounds are quantiles; the number of ranges, and so all that the driver holds, is the number of partitions.
    """
    n = partitions(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quantiles = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10000)).first()[0] or []
    bounds = F.array(*[F.lit(int(q)).cast("long") for q in sorted(set(quantiles))]) if quantiles else F.array().cast("array<long>")
    size = len(set(quantiles))
    steps = [1 << k for k in range(max(size, 1).bit_length() - 1, -1, -1)]
    # binary search: how many bounds are at or below doc_id
    part = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= size) & (F.coalesce(F.get(bounds, lo + s - 1), F.lit(0)) <= F.col("doc_id")), lo + s).otherwise(lo))
    docs = docs.withColumn("part", part)
    firsts = {r["part"]: r["m"] for r in docs.groupBy("part").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("tie"))).alias("m")).collect()}
    have = sorted(firsts)
    if not have:
        return docs.withColumn("halo", F.lit(0))
    before = dict(zip(have, [have[-1], *have[:-1]], strict=True))
    pick = lambda f, kind: F.element_at(F.create_map(*[F.lit(x) for p in have for x in (p, f(p))]).cast(f"map<int,{kind}>"), F.col("part"))
    is_first = F.col("doc_id").eqNullSafe(pick(lambda p: firsts[p]["doc_id"], "bigint")) & (F.xxhash64("text") == pick(lambda p: firsts[p]["tie"], "bigint"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("halo"))
    also = F.struct(pick(lambda p: before[p], "int").alias("part"), F.lit(1).alias("halo"))
    docs = docs.withColumn("to", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own)))).select("to.*", "doc_id", "text")
    return docs.repartitionById(n, F.col("part")).sortWithinPartitions("part", "halo", "doc_id", F.xxhash64("text"))


OUT = "doc_id long, n_chars long, edited_sha256 binary, fp binary, efp binary, near_edited double, near_next double"
_SHAS = ", sha binary, esha binary"


def _compare(with_shas: bool):
    schema = OUT + _SHAS * with_shas
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    types = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    @tidy
    def run(batches):
        """Streams a sorted partition; holds one text besides the batch."""
        kept, out = None, {n: [] for n in types.names}
        for batch in batches:
            for part, halo, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "doc_id", "text")), strict=True):
                if kept and kept[0] != part:
                    kept = None
                if halo and not kept:
                    continue
                own = _digests(text)
                if kept:
                    _, last, before, (canon, fp) = kept
                    cut = len(before) // 4
                    edited = before[: len(before) - cut] + text[:cut]
                    ecanon, efp = _digests(edited) if edited != before else (canon, fp)
                    row = [last, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(), fp, efp, float(canon == ecanon), float(canon == own[0])]
                    row += [hashlib.sha256(c).digest() for c in (canon, ecanon)] if with_shas else []
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                kept = None if halo else (part, doc, text, own)
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=types)
                out = {k: [] for k in out}

    return run, schema


def mixed_buckets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The fingerprints whose bucket holds different bytes. Only texts in buckets of two or more rows are compared.

    Texts of other buckets are left out by a filter of bounded size; the few that pass it are alone in their bucket and
    do no harm. The least and the greatest canonical text of a bucket are found with partial aggregates, so a bucket
    with a third of all rows is never in one task.
    """
    # a table of its own: adaptive execution can then split a common fingerprint
    several = Scratch(docs.sparkSession, "several").table(rows.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "several")
    ids = rows.where("doc_id is not null").join(several, "fp", "left_semi").select("doc_id").distinct()
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(docs.sparkSession, ids))

    @tidy
    def canon(batches):
        for batch in batches:
            wanted = in_filter(sent.value, pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            texts = [canonical(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").filter(pa.array(wanted)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array(texts, pa.binary())], ["fp", "canon"])

    texts = docs.select("doc_id", "text").mapInArrow(canon, "fp binary, canon binary")
    return texts.groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("fp", F.lit(True).alias("mixed"))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text)."""
    scratch = Scratch(spark, "digest")
    made = lambda shas: by_next(spark, docs).select("part", "halo", "doc_id", "text").mapInArrow(*_compare(shas))
    rows = scratch.table(made(False), "rows")
    mixed = scratch.table(mixed_buckets(docs, rows), "mixed")
    text = lambda c: F.lower(F.hex(c))
    names = [text("fp"), text("efp")]
    if not mixed.isEmpty():  # equal hashes of different bytes: the names of those buckets get longer
        rows = scratch.table(made(True), "named").join(mixed, "fp", "left").join(mixed.select(F.col("fp").alias("efp"), F.col("mixed").alias("emixed")), "efp", "left")
        names = [F.when(F.col(m), F.concat_ws(":", n, text(sha))).otherwise(n) for n, m, sha in zip(names, ("mixed", "emixed"), ("sha", "esha"), strict=True)]
    return rows.select("doc_id", "n_chars", text("edited_sha256").alias("edited_sha256"), names[0].alias("fingerprint"), names[1].alias("edited_fingerprint"), "near_edited", "near_next")


def op10_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))
