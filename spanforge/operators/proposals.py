"""Proposals: alignment of model rows to the text, and the pool that merges equal spans of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_id
from .document import lines, occurrences

SEED, MODEL, ALIAS = "e3", "qwen_context", "governed_alias"
TYPES = ("TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM")


def align(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(doc_id, seq, line_id, text, occurrence, ...) with start, end, how, reason.

    A named line decides alone: if it holds the text too few times the row is refused. Otherwise the text must occur
    once in the document. Refused rows keep start = -1 and name one of five reasons.
    """
    rest = [c for c in rows.columns if c not in ("doc_id", "text", "line_id", "occurrence")]
    l = lines(docs).select("doc_id", "line_id", F.col("start").alias("__ls"), F.col("text").alias("__line"))  # noqa: E741
    r = rows.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    r = r.join(l, ["doc_id", "line_id"], "left").join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id")
    r = r.withColumn("__in_line", F.when(F.col("__line").isNotNull(), occurrences(F.col("__line"), F.col("text"))).otherwise(F.array().cast("array<int>")))
    r = r.withColumn("__in_doc", F.when(F.size("__in_line") == 0, occurrences(F.col("__text"), F.col("text"))).otherwise(F.array().cast("array<int>")))
    reason = (
        F.when(F.col("text") == "", "empty_text")
        .when((F.size("__in_line") > 0) & ((F.col("occurrence") < 0) | (F.col("occurrence") >= F.size("__in_line"))), "occurrence_out_of_range")
        .when((F.size("__in_line") == 0) & (F.size("__in_doc") == 0), F.when(F.col("__line").isNull(), "unknown_line_id").otherwise("text_not_in_source"))
        .when((F.size("__in_line") == 0) & (F.size("__in_doc") > 1), "ambiguous_without_line")
    )
    start = F.when(F.size("__in_line") > 0, F.col("__ls") + F.get("__in_line", F.col("occurrence").cast("int"))).otherwise(F.get("__in_doc", F.lit(0)))
    r = r.withColumn("reason", reason).withColumn("start", F.when(F.col("reason").isNull(), start).otherwise(F.lit(-1)).cast("long"))
    end = F.when(F.col("reason").isNull(), F.col("start") + F.length("text")).otherwise(F.lit(-1)).cast("long")
    how = F.when(F.col("reason").isNotNull(), F.lit("")).when(F.size("__in_line") > 0, "line").otherwise("unique")
    own_line = line_id(F.size(F.split(F.substring("__text", F.lit(1), F.col("start").cast("int")), "\n", -1)))
    line = F.when(how == "unique", own_line).otherwise(F.col("line_id"))
    return r.select("doc_id", line.alias("line_id"), "text", "occurrence", *rest, "start", end.alias("end"), how.alias("how"), "reason")


def pool(rows: DataFrame) -> DataFrame:
    """Equal (doc_id, start, end, type) once, with the sorted union of sources; line_id and how of the first by seq."""
    return rows.groupBy("doc_id", "start", "end", "type").agg(F.min("text").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.min_by("line_id", "seq").alias("line_id"), F.min_by("how", "seq").alias("how"))


def mark_completions(pooled: DataFrame) -> DataFrame:
    """With subsumes_seed: not a seed itself, but strictly around a seed of its type. A containment semi-join."""
    seeds = pooled.where(F.array_contains("sources", SEED)).select(F.col("doc_id").alias("__d"), F.col("type").alias("__t"), F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    inside = (F.col("doc_id") == F.col("__d")) & (F.col("type") == F.col("__t")) & (F.col("start") <= F.col("__s")) & (F.col("__e") <= F.col("end")) & ((F.col("start") != F.col("__s")) | (F.col("end") != F.col("__e")))
    around = pooled.where(~F.array_contains("sources", SEED)).join(seeds, inside, "left_semi").select("doc_id", "start", "end", "type", F.lit(True).alias("__c"))
    return pooled.join(around, ["doc_id", "start", "end", "type"], "left").withColumn("subsumes_seed", F.coalesce("__c", F.lit(False))).drop("__c")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("doc_id", "start", F.desc("end"), "type")


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "type")) - 1).cast("long"))
