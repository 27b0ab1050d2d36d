"""Facts about candidates, as the lines that a reranker is shown and as one text for an encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kb import drug_conflicts, icd_facts

_TEXTS = "array<string>"
_STRENGTHS = "array<struct<value:string,unit:string,raw:string>>"


def _listed(c: str, most: int, sep: str) -> Column:
    return F.array_join(F.slice(F.coalesce(c, F.array().cast(_TEXTS)), 1, most), sep)


def _some(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def _shown(strength: Column) -> Column:
    """A strength as it was written, else its key."""
    return F.coalesce(F.when(strength["raw"] != "", strength["raw"]), F.concat(strength["value"], strength["unit"]))


def icd_lines(concepts: DataFrame) -> DataFrame:
    """concept_id, lines."""
    others = F.when(F.size(F.coalesce("aliases", F.array().cast(_TEXTS))) > 0, F.concat(F.lit("  also called: "), _listed("aliases", 4, "; ")))
    group = F.when(F.col("parent_code") != "", F.rtrim(F.concat(F.lit("  category: "), "parent_code", F.lit(" "), "parent_label")))
    near = F.when(F.col("sibling_count") > 0, F.concat(F.lit("  competing sibling codes in this category: "), F.col("sibling_count").cast("string")))
    first = F.concat(F.lit("code "), "code", F.lit(": "), "label")
    return icd_facts(concepts).select(F.col("code").alias("concept_id"), F.array_compact(F.array(first, others, group, near)).alias("lines"))


def drug_facts(candidates: DataFrame, concepts: DataFrame, drugs: DataFrame) -> DataFrame:
    """mention, concept_id, label, tty, ingredients, strength, dose_form, conflicts of candidates(mention, concept_id).

    Candidates that no concept has are dropped; a concept without a structured record has no facts and no conflicts.
    drugs: rxcui (or concept_id), ingredients, strengths, dose_forms, rxterm_form, available_strength; what is missing is null.
    """
    known = concepts.select("concept_id", F.col("canonical_name").alias("label"), F.coalesce(F.col("metadata")["tty"], F.lit("")).alias("tty"))
    rows = candidates.select("mention", "concept_id").distinct().join(known, "concept_id")
    kinds = {"ingredients": _TEXTS, "strengths": _STRENGTHS, "dose_forms": _TEXTS, "rxterm_form": "string", "available_strength": "string"}
    fields = [F.col(c) if c in drugs.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    record = drugs.select(F.col("rxcui" if "rxcui" in drugs.columns else "concept_id").alias("concept_id"), *fields, F.lit(True).alias("known"))
    rows = drug_conflicts(rows.join(record, "concept_id", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    first = F.get(F.coalesce("strengths", F.array().cast(_STRENGTHS)), F.lit(0))
    strength = F.coalesce(_shown(first), F.col("available_strength"), F.lit(""))
    form = F.coalesce(F.get(F.coalesce("dose_forms", F.array().cast(_TEXTS)), F.lit(0)), F.col("rxterm_form"), F.lit(""))
    return rows.select("mention", "concept_id", "label", "tty", F.slice(F.coalesce("ingredients", F.array().cast(_TEXTS)), 1, 3).alias("ingredients"), strength.alias("strength"), form.alias("dose_form"), "conflicts")


def drug_lines(facts: DataFrame) -> DataFrame:
    """mention, concept_id, lines of drug_facts()."""
    detail = F.concat_ws("; ", _some("TTY ", F.col("tty")), _some("ingredient ", _listed("ingredients", 2, "/")), _some("strength ", F.col("strength")), _some("form ", F.col("dose_form")))
    first = F.concat(F.lit("RxCUI "), "concept_id", F.lit(": "), "label")
    against = F.when(F.size("conflicts") > 0, F.concat(F.lit("  CONFLICTS WITH THE MENTION: "), F.array_join("conflicts", ", ")))
    return facts.select("mention", "concept_id", F.array_compact(F.array(first, F.when(detail != "", F.concat(F.lit("  "), detail)), against)).alias("lines"))


def candidate_lines(candidates: DataFrame, concepts: DataFrame, drugs: DataFrame) -> DataFrame:
    """mention, ontology, concept_id, lines of candidates(mention, ontology, concept_id): each ontology's own facts."""
    own = lambda df, o: df.where(F.col("ontology") == o)
    asked = candidates.select("mention", "ontology", "concept_id").distinct()
    icd = own(asked, "ICD10").join(icd_lines(own(concepts, "ICD10")), "concept_id").select("mention", "ontology", "concept_id", "lines")
    rx = drug_lines(drug_facts(own(asked, "RXNORM"), own(concepts, "RXNORM"), drugs)).select("mention", F.lit("RXNORM").alias("ontology"), "concept_id", "lines")
    return icd.unionByName(rx)


def drug_text(drugs: DataFrame, most: int = 6) -> DataFrame:
    """rxcui, text: the recovered fields of a record, labelled and in one order. Fields that drugs has no column of are left out."""
    has = set(drugs.columns)
    column = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    many = lambda c: F.array_join(F.slice(F.coalesce(column(c, _TEXTS), F.array().cast(_TEXTS)), 1, most), "; ")
    strong = F.array_join(F.transform(F.slice(F.coalesce(column("strengths", _STRENGTHS), F.array().cast(_STRENGTHS)), 1, 4), _shown), "; ")
    either = lambda label, first, second: F.coalesce(_some(label, first), _some(label, second))
    parts = [
        F.concat(F.lit("RxCUI "), "rxcui"), _some("", column("name")), _some("TTY: ", column("tty")), _some("ingredient: ", many("ingredients")), _some("precise ingredient: ", many("precise_ingredients")),
        either("strength: ", strong, column("available_strength")), either("dose form: ", many("dose_forms"), column("rxterm_form")), _some("brand: ", many("brands")), _some("quantity: ", column("quantity")),
    ]
    return drugs.select("rxcui", F.concat_ws(" | ", *parts).alias("text"))
