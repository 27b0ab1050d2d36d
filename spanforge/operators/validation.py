"""Validation and derivation: constraint queries over organizer entities, file sets and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import icd_class, to_dotted
from .document import slice_of
from .proposals import TYPES
from .resolver import FIELDS

# Internal type names, refused in output.
INTERNAL = ("MEDICATION", "DIAGNOSIS", "SYMPTOM", "TEST_NAME", "TEST_RESULT")
LABELS = ("isNegated", "isHistorical", "isFamily")
DOTTED_OUTPUT = r"^[A-TV-Z][0-9]{2}(?:\.[0-9]{1,2})?$"


def _fields(kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, (asserted, coded) in FIELDS.items():
        own = ["text", "type", *(["candidates"] if coded else []), *(["assertions"] if asserted else []), "position"]
        out = F.when(kind == name, F.array(*[F.lit(f) for f in own])).otherwise(out)
    return out


def entity_issues(rows: DataFrame, column: str = "entity") -> DataFrame:
    """rows with issues: the sorted codes of every rule that the JSON object breaks."""
    e = F.col(column)
    get = lambda path: F.get_json_object(e, f"$.{path}")
    keys = F.coalesce(F.json_object_keys(e), F.array().cast("array<string>"))
    kind = get("type")
    is_object = F.coalesce(F.ltrim(e).startswith("{") & F.json_object_keys(e).isNotNull(), F.lit(False))
    allowed = _fields(kind)
    known = kind.isin(*TYPES)
    none = F.array().cast("array<string>")
    if_any = lambda cond, code: F.when(cond, F.array(F.lit(code))).otherwise(none)
    has = lambda f: F.array_contains(keys, f)
    listed = lambda f: F.coalesce(F.ltrim(get(f)).startswith("["), F.lit(False))
    strings = lambda f: F.coalesce(F.from_json(get(f), "array<string>"), none)
    parts = F.when(listed("position"), F.transform(F.filter(F.split(F.regexp_replace(get("position"), r"[\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x)).otherwise(none)
    whole = (F.size(parts) == 2) & F.forall(parts, lambda x: x.rlike(r"^-?[0-9]+$"))
    start, end = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    raw_items = lambda f: F.from_json(get(f), "array<string>")
    position = F.when(~whole, F.array(F.lit("bad_position"))).otherwise(F.concat(if_any(start < 0, "negative_start"), if_any(end < start, "end_before_start")))
    coded = has("candidates") & F.array_contains(allowed, "candidates")
    candidate = F.when(~listed("candidates"), F.array(F.lit("candidates_not_list"))).otherwise(
        F.concat(
            F.transform(F.filter(raw_items("candidates"), lambda c: c.isNull() | (c == "")), lambda c: F.lit("candidate_not_str")),
            F.when(kind == "THUỐC", F.transform(F.filter(strings("candidates"), lambda c: c.isNotNull() & (c != "") & ~c.rlike("^[0-9]+$")), lambda c: F.lit("rxnorm_not_numeric"))).otherwise(none),
        )
    )
    asserted = has("assertions") & F.array_contains(allowed, "assertions")
    labels = strings("assertions")
    good = F.filter(labels, lambda a: a.isin(*LABELS))
    assertion = F.when(~listed("assertions"), F.array(F.lit("assertions_not_list"))).otherwise(
        F.concat(F.transform(F.filter(labels, lambda a: ~F.coalesce(a.isin(*LABELS), F.lit(False))), lambda a: F.lit("invalid_assertion")), F.array_repeat(F.lit("duplicate_assertion"), F.size(good) - F.size(F.array_distinct(good))))
    )
    fields = F.concat(
        F.transform(F.array_except(allowed, keys), lambda f: F.concat(F.lit("missing_field:"), f)),
        F.transform(F.array_except(keys, allowed), lambda f: F.concat(F.lit("unsupported_field:"), f)),
        if_any(has("text") & (F.coalesce(get("text"), F.lit("")) == ""), "bad_text"),
        F.when(has("position"), position).otherwise(none),
        F.when(coded, candidate).otherwise(none),
        F.when(asserted, assertion).otherwise(none),
    )
    issues = F.when(~is_object, F.array(F.lit("not_object"))).when(~F.coalesce(known, F.lit(False)), F.array(F.when(kind.isin(*INTERNAL), "english_type").otherwise("invalid_type"))).otherwise(fields)
    return rows.withColumn("issues", F.array_sort(issues))


def document_entities(files: DataFrame) -> DataFrame:
    """files(name, content) as one row an entity (name, entity_index, entity), and rows with an issue for bad payloads."""
    items = F.from_json("content", "array<string>")
    listed = F.coalesce(F.ltrim("content").startswith("["), F.lit(False)) & items.isNotNull()
    good = files.where(listed).select("name", F.posexplode(items).alias("entity_index", "entity"), F.lit(None).cast("string").alias("issue"))
    bad = files.where(~listed).select("name", F.lit(-1).alias("entity_index"), F.lit(None).cast("string").alias("entity"), F.when(F.try_parse_json("content").isNull(), "not_json").otherwise("root_not_list").alias("issue"))
    return good.unionByName(bad)


def fileset_diff(have: DataFrame, want: DataFrame, key: str = "name") -> DataFrame:
    """key, issue: missing from or unexpected in a set of files. Two anti-joins."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("issue", F.lit("missing_file")).unionByName(a.join(b, key, "left_anti").withColumn("issue", F.lit("unexpected_file")))


def governed_issues(entities: DataFrame, docs: DataFrame, governed: DataFrame) -> DataFrame:
    """doc_id, start, end, issue: offsets that don't cut the text, codes of bad form, codes that no concept has."""
    cut = entities.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id").where(slice_of("__text", "start", "end") != F.col("text")).select("doc_id", "start", "end", F.lit("offsets_do_not_match").alias("issue"))
    codes = entities.where(F.col("type").isin("CHẨN_ĐOÁN", "THUỐC")).select("doc_id", "start", "end", "type", F.explode("candidates").alias("code"))
    icd = codes.where(F.col("type") == "CHẨN_ĐOÁN")
    form = icd.where(~F.col("code").rlike(DOTTED_OUTPUT)).select("doc_id", "start", "end", F.lit("not_dotted").alias("issue"))
    known = governed.select("ontology", F.col("concept_id").alias("__c")).distinct()
    plain = icd.where(F.col("code").rlike(DOTTED_OUTPUT)).select("doc_id", "start", "end", F.lit("ICD10").alias("ontology"), F.replace("code", F.lit("."), F.lit("")).alias("__c"))
    drug = codes.where(F.col("type") == "THUỐC").select("doc_id", "start", "end", F.lit("RXNORM").alias("ontology"), F.col("code").alias("__c"))
    loose = plain.unionByName(drug).join(known, ["ontology", "__c"], "left_anti").select("doc_id", "start", "end", F.lit("ungoverned_code").alias("issue"))
    return cut.unionByName(form).unionByName(loose)


def derive_codes(entities: DataFrame, keep: int | None = None, strict: bool = True) -> DataFrame:
    """entities with dotted diagnosis codes, at most `keep` of each list; a malformed code is an error, or null if not strict."""
    fail = lambda c: F.raise_error(F.concat(F.lit("malformed code "), c)).cast("string") if strict else F.lit(None).cast("string")
    dotted = F.transform("candidates", lambda c: F.when(icd_class(c) == "malformed", fail(c)).otherwise(to_dotted(c)))
    new = F.when(F.col("type") == "CHẨN_ĐOÁN", dotted).otherwise(F.col("candidates"))
    return entities.withColumn("candidates", F.slice(new, 1, keep) if keep else new)


def derivation_diff(before: DataFrame, after: DataFrame, allowed: str = "candidates") -> DataFrame:
    """doc_id, idx, field of every difference beside the allowed field; rows on one side only show as `row`."""
    fields = [c for c in before.columns if c not in ("doc_id", "idx", allowed)]
    a = before.select("doc_id", "idx", F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in fields])
    b = after.select("doc_id", "idx", F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in fields])
    both = a.join(b, ["doc_id", "idx"], "full_outer")
    odd = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in fields]))
    lone = F.col("__a").isNull() | F.col("__b").isNull()
    return both.select("doc_id", "idx", F.explode(F.when(lone, F.array(F.lit("row"))).otherwise(odd)).alias("field"))


def split_severity(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    return issues.where("severity = 'error'"), issues.where("severity = 'warning'")


def budget_issues(models: DataFrame, cap: int = 9_000_000_000) -> DataFrame:
    """model, issue: not measured, licence to review, revision not pinned; and `over_cap` on the sum."""
    from ..functions.text import is_pinned

    rows = models.select("model", F.explode(F.array_compact(F.array(F.when(F.col("parameters").isNull(), "unmeasured"), F.when(~F.coalesce("licence_cleared", F.lit(False)), "licence_review"), F.when(~is_pinned("revision"), "revision_not_pinned")))).alias("issue"))
    over = models.agg(F.sum("parameters").alias("n")).where(F.col("n") >= cap).select(F.lit("*").alias("model"), F.lit("over_cap").alias("issue"))
    return rows.unionByName(over)
