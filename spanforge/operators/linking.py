"""Linking: mentions, query views, pruning, option order, selection, confidence, attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, squeeze, strength_keys
from .document import slice_of

# Which types are linked to which ontology, and words of dose forms and routes.
ONTOLOGY = {"CHẨN_ĐOÁN": "ICD10", "THUỐC": "RXNORM"}
FORM_WORDS = {
    "tablet": ("viên nén", "viên"),
    "capsule": ("viên nang", "nang"),
    "injection": ("tiêm", "ống", "lọ tiêm"),
    "solution": ("dung dịch", "siro", "sirô"),
    "cream": ("kem", "mỡ", "thuốc mỡ"),
    "suppository": ("viên đặt", "đặt"),
}
ROUTE_WORDS = {
    "oral": ("uống", "po", "đường uống"),
    "injection": ("tiêm", "iv", "im", "truyền"),
    "topical": ("bôi", "thoa", "ngoài da"),
    "rectal": ("đặt hậu môn",),
    "inhalation": ("xịt", "khí dung", "hít"),
}
#: What looks like a code of either ontology, as a word of its own.
CODE_SHAPED = r"(?<![\p{L}\p{N}_])(?:[A-TV-Z][0-9]{2,4}(?:\.[0-9]{1,2})?|[0-9]{4,8})(?![\p{L}\p{N}_])"
ANSWER = r"""^[\s"'`]*\[?([A-Z]{1,4})\]?[\s"'`.]*$"""
MAX_OPTIONS = 20


def ontology_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in ONTOLOGY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def mentions(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Linkable entities with their ontology and the mention re-cut from the text."""
    rows = entities.withColumn("ontology", ontology_of(F.col("type"))).where("ontology is not null")
    return rows.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id").withColumn("mention", slice_of("__text", "start", "end")).drop("__text")


def cache_key(columns: list[str]) -> Column:
    """sha256 of the JSON object of the columns, keys in order."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in sorted(columns)])), 256)


def distinct_prompts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a cache key; the answer is joined back on it, so each prompt is asked once."""
    return rows.withColumn("cache_key", cache_key(columns)).groupBy("cache_key").agg(*[F.min(c).alias(c) for c in columns], F.count("*").alias("uses"))


def parse_reformulation(reply: Column) -> tuple[Column, Column, Column]:
    """(canonical_vi, canonical_en, parse_failed) of the first {...} of a reply; a view shaped like a code is dropped."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*?\}", 0)
    obj = F.from_json(F.when(body != "", body), "canonical_vi string, canonical_en string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    failed = obj.isNull() | obj["_bad"].isNotNull()
    view = lambda c: F.when(failed, "").otherwise(F.when(squeeze(F.coalesce(obj[c], F.lit(""))).rlike(CODE_SHAPED), "").otherwise(squeeze(F.coalesce(obj[c], F.lit("")))))
    return view("canonical_vi"), view("canonical_en"), failed


def views(raw: Column, vi: Column, en: Column) -> Column:
    """array<struct<view, text>>: distinct, not empty, the raw mention first. A view keeps its own name."""
    rows = F.array(*[F.struct(F.lit(n).alias("view"), squeeze(F.coalesce(c, F.lit(""))).alias("text")) for n, c in (("raw", raw), ("canonical_vi", vi), ("canonical_en", en))])
    keep = lambda acc, v: F.when((v["text"] == "") | F.exists(acc, lambda a: fold(a["text"]) == fold(v["text"])), acc).otherwise(F.concat(acc, F.array(v)))
    return F.aggregate(rows, F.array().cast("array<struct<view:string,text:string>>"), keep)


def stated(mention: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """Categories one of whose words the mention holds between spaces."""
    text = F.concat(F.lit(" "), squeeze(fold(mention)), F.lit(" "))
    said = lambda words: F.greatest(F.lit(False), *[F.contains(text, F.lit(f" {w} ")) for w in words])
    return F.array_compact(F.array(*[F.when(said(w), c) for c, w in vocabulary.items()]))


def recorded(text: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(fold(text), F.lit(c)), c) for c in vocabulary]))


def disagree(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def prune(candidates: DataFrame, governed: DataFrame, drugs: DataFrame) -> DataFrame:
    """candidates(mention, type, ontology, concept_id) with reason: the first gate that fails, null for what stays.

    governed(ontology, concept_id); drugs(concept_id, strengths, dose_forms, rxterm_form).
    """
    known = governed.select(F.col("ontology").alias("__o"), F.col("concept_id").alias("__c")).distinct().withColumn("__known", F.lit(True))
    rows = candidates.join(known, (F.col("ontology") == F.col("__o")) & (F.col("concept_id") == F.col("__c")), "left")
    recorded_keys = F.transform(F.coalesce("strengths", F.array().cast("array<struct<value:string,unit:string,raw:string>>")), lambda s: F.concat(s["value"], s["unit"]))
    forms = F.trim(F.concat_ws(" ", F.coalesce("dose_forms", F.array().cast("array<string>")), F.coalesce("rxterm_form", F.lit(""))))
    d = drugs.select(F.col("concept_id").alias("__d"), recorded_keys.alias("__keys"), forms.alias("__forms"))
    rows = rows.join(d, (F.col("concept_id") == F.col("__d")) & (F.col("ontology") == "RXNORM"), "left")
    m, text = F.col("mention"), F.coalesce("__forms", F.lit(""))
    keys = F.coalesce("__keys", F.array().cast("array<string>"))
    reason = (
        F.when(~F.col("ontology").eqNullSafe(ontology_of(F.col("type"))), "wrong_ontology")
        .when(F.col("__known").isNull(), "not_governed")
        .when(disagree(strength_keys(m), keys), "strength_conflict")
        .when(disagree(stated(m, FORM_WORDS), recorded(text, FORM_WORDS)), "dose_form_conflict")
        .when(disagree(stated(m, ROUTE_WORDS), recorded(text, ROUTE_WORDS)), "route_conflict")
    )
    return rows.select(*candidates.columns, reason.alias("reason"))


def option_order(candidates: DataFrame) -> DataFrame:
    """(mention_id, mention, concept_id) with position and letter: sorted ids, turned by a digest of the mention."""
    rows = candidates.select("mention_id", "mention", "concept_id").distinct()
    by = Window.partitionBy("mention_id")
    n = F.count("*").over(by)
    k = F.row_number().over(by.orderBy("concept_id")) - 1
    turn = F.conv(F.substring(F.sha2("mention", 256), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("n", n).withColumn("k", k)
    position = F.pmod(F.col("k") - F.pmod(turn, F.col("n")), F.col("n")).cast("long")
    rows = rows.withColumn("position", position).where(F.col("position") < MAX_OPTIONS)
    return rows.select("mention_id", "mention", "concept_id", "position", F.chr(F.lit(65) + F.col("position")).alias("letter"))


def parse_selection(replies: DataFrame, options: DataFrame) -> DataFrame:
    """replies(mention_id, reply) with decision (SELECT or NONE), concept_id, letter and the reason of a refusal."""
    text = F.trim(F.regexp_replace(F.coalesce("reply", F.lit("")), r"^[\s]+|[\s]+$", ""))
    rows = replies.withColumn("__text", text).withColumn("letter", F.regexp_extract("__text", ANSWER, 1))
    words = F.array_distinct(F.regexp_extract_all("__text", F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{1,4}(?![\p{L}\p{N}_])"), F.lit(0)))
    o = options.select("mention_id", "letter", "concept_id")
    rows = rows.join(o, ["mention_id", "letter"], "left")
    reason = (
        F.when(F.col("__text") == "", "parse_failed")
        .when(F.col("__text").rlike(CODE_SHAPED), "returned_a_code")
        .when(F.col("letter") == "", F.when(F.size(words) > 1, "multiple_options").otherwise("parse_failed"))
        .when((F.col("letter") != "NONE") & F.col("concept_id").isNull(), "invalid_option")
    )
    chosen = reason.isNull() & (F.col("letter") != "NONE")
    return rows.select(*replies.columns, F.when(chosen, "SELECT").otherwise("NONE").alias("decision"), F.when(chosen, F.col("concept_id")).alias("concept_id"), F.when(reason.isNull(), F.col("letter")).otherwise("").alias("letter"), reason.alias("reason"))


def confidence(exact: Column, retrievers: Column, view_count: Column, least: int = 2) -> Column:
    return F.when(exact, "exact_governed_alias").when(retrievers >= least, "independent_retriever_agreement").when(view_count >= least, "independent_query_view_agreement").otherwise("single_source_only")


def candidates_for(variant: str, concept: Column, reason: Column) -> Column:
    """allnull: none; high: the selected concept if its reason is not a single source; broad: the selected concept."""
    none = F.array().cast("array<string>")
    if variant == "allnull":
        return none
    ok = concept.isNotNull() if variant == "broad" else concept.isNotNull() & (reason != "single_source_only")
    return F.when(ok, F.array(concept)).otherwise(none)


def attach(entities: DataFrame, records: DataFrame) -> DataFrame:
    """entities with the candidates of the record of their span and type; others keep none. An outer join."""
    r = records.select("doc_id", "start", "end", "type", "candidates")
    return entities.join(r, ["doc_id", "start", "end", "type"], "left")
