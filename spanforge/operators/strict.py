"""The strict check of a model's proposals: only what the text and the offered candidates prove is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import normalized
from .assertions import ASSERTED_TYPES
from .document import occurrences
from .proposals import TYPES

LINKED_TYPES = ("THUỐC", "CHẨN_ĐOÁN")
NAMES = ("isNegated", "isFamily", "isHistorical")


def next_occurrences(proposals: DataFrame, docs: DataFrame) -> DataFrame:
    """proposals(doc_id, idx, text, ...) with start, end of the next unused occurrence of their text, and n_there.

    The first proposal of a text takes its first occurrence, the second the next: a rank instead of a counter. The
    occurrences of a distinct text are looked for once.
    """
    turn = Window.partitionBy("doc_id", "text").orderBy("idx")
    rows = proposals.withColumn("__turn", F.row_number().over(turn))
    found = rows.select("doc_id", "text").distinct().join(docs.select("doc_id", F.col("text").alias("__source")), "doc_id")
    found = found.select("doc_id", "text", occurrences(F.col("__source"), F.col("text")).alias("__at"))
    rows = rows.join(found, ["doc_id", "text"], "left").withColumn("start", F.get("__at", F.col("__turn") - 1).cast("long"))
    return rows.withColumn("end", F.col("start") + F.length("text")).withColumn("n_there", F.coalesce(F.size("__at"), F.lit(0))).drop("__turn", "__at")


def strictly(proposals: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities(doc_id, text, type, start, end, assertions, candidates), rejected(doc_id, reason, n)) of
    proposals(doc_id, idx, text, type, assertions array, candidates array, offered array)."""
    none = F.array().cast("array<string>")
    rows = normalized(proposals, "text").withColumn("text", F.trim("text"))
    early = F.when(F.coalesce("text", F.lit("")) == "", "empty_text").when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "unknown_type")
    rows = rows.withColumn("reason", early)
    live = next_occurrences(rows.where("reason is null").drop("reason"), docs)
    late = F.when(F.col("start").isNull(), F.when(F.col("n_there") > 0, "occurrence_exhausted").otherwise("span_not_found"))
    live = live.withColumn("reason", late)
    kept = live.where("reason is null")
    said = F.filter(F.array(*[F.lit(n) for n in NAMES]), lambda n: F.array_contains(F.coalesce("assertions", none), n))
    wanted = F.filter(F.transform(F.coalesce("candidates", none), lambda c: F.trim(c)), lambda c: c != "")
    linked = F.col("type").isin(*LINKED_TYPES)
    governed = F.array_distinct(F.filter(wanted, lambda c: F.array_contains(F.coalesce("offered", none), c)))
    stray = F.when(linked, F.size(F.filter(wanted, lambda c: ~F.array_contains(F.coalesce("offered", none), c)))).otherwise(0)
    out = kept.select("doc_id", "text", "type", "start", "end", F.when(F.col("type").isin(*ASSERTED_TYPES), said).otherwise(none).alias("assertions"), F.when(linked, governed).otherwise(none).alias("candidates"))
    reasons = rows.where("reason is not null").select("doc_id", "reason", F.lit(1).alias("n"))
    reasons = reasons.unionByName(live.where("reason is not null").select("doc_id", "reason", F.lit(1).alias("n")))
    reasons = reasons.unionByName(kept.select("doc_id", F.lit("ungoverned_candidate").alias("reason"), stray.alias("n")).where("n > 0"))
    return out, reasons.groupBy("doc_id", "reason").agg(F.sum("n").alias("n"))
