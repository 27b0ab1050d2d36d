"""Knowledge base: postings, facts of concepts, retrieval documents, and the relational drug snapshot.

concepts(ontology, concept_id, canonical_name, aliases, metadata)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accent_marked, char_ngrams, fold, is_damaged_title, normalize_text, normalize_unit, strength_keys, tokens

# Relations of the drug snapshot that remap a retired identifier, and that give a drug its structure.
REMAP_RELATIONS = ("replaced_by", "remapped_to", "mapped_to")
STRUCTURE_RELATIONS = ("has_ingredient", "ingredient_of", "has_precise_ingredient", "consists_of", "constitutes", "has_dose_form", "dose_form_of", "has_form", "form_of", "tradename_of", "has_tradename")
RECOVERED_RELATIONS = ("has_ingredient", "has_precise_ingredient", "has_dose_form", "tradename_of", "consists_of", "isa")
# Words that say a drug has some dose form.
FORM_CUES = ("viên", "ống", "tiêm", "siro", "kem", "gói")


def postings(concepts: DataFrame, tiered: bool = False) -> DataFrame:
    """(ontology, channel, term, concept_id): the long form of the inverted index."""
    forms = F.filter(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    rows = concepts.select("ontology", "concept_id", F.posexplode(forms).alias("k", "form"))
    channels = [
        ("exact_canonical", F.when(F.col("k") == 0, F.array(normalize_text("form")))) if tiered else ("exact", F.array(normalize_text("form"))),
        ("exact_ascii", F.array(normalize_text("form", True))),
        ("char_ngram", char_ngrams("form")),
        ("sparse", tokens("form")),
    ]
    if tiered:
        channels += [("exact_alias", F.when(F.col("k") > 0, F.array(normalize_text("form")))), ("char_ngram_accent", accent_marked(char_ngrams("form", strip_accents=False))), ("sparse_accent", accent_marked(tokens("form", False)))]
    mark = lambda c: (lambda x: F.struct(F.lit(c).alias("channel"), x.alias("term")))
    terms = F.concat(*[F.transform(F.coalesce(t, F.array().cast("array<string>")), mark(c)) for c, t in channels])
    return rows.select("ontology", "concept_id", F.explode(terms).alias("t")).select("ontology", "t.channel", "t.term", "concept_id").distinct()


def icd_facts(concepts: DataFrame) -> DataFrame:
    """code, label, parent_code, parent_label, sibling_count, child_count: by joins and counts, not by scans of all codes."""
    rows = concepts.select(F.col("concept_id").alias("code"), "canonical_name", F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 6).alias("aliases"))
    parent = rows.select(F.col("code").alias("__p"), F.col("canonical_name").alias("__label"))
    prefix = F.substring("code", 1, 3)
    same = Window.partitionBy(prefix, F.length("code"))
    rows = rows.withColumn("sibling_count", F.when(F.length("code") > 3, F.count("*").over(same) - 1).otherwise(0).cast("long"))
    above = rows.where(F.length("code") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda n: F.substring(F.col("code"), F.lit(1), n))).alias("__c")).groupBy("__c").agg(F.count("*").alias("child_count"))
    out = rows.join(above, F.col("code") == F.col("__c"), "left").join(parent, (prefix == F.col("__p")) & (F.col("code") != F.col("__p")), "left")
    return out.select("code", F.when(is_damaged_title("canonical_name"), "").otherwise(F.col("canonical_name")).alias("label"), "aliases", F.coalesce("__p", F.lit("")).alias("parent_code"), F.coalesce("__label", F.lit("")).alias("parent_label"), "sibling_count", F.coalesce("child_count", F.lit(0)).alias("child_count"))


def drug_conflicts(rows: DataFrame) -> DataFrame:
    """rows(mention, ingredients, strengths, dose_forms, rxterm_form, known) with the array conflicts."""
    said = strength_keys("mention")
    recorded = F.transform(F.coalesce("strengths", F.array().cast("array<struct<value:string,unit:string,raw:string>>")), lambda s: F.concat(s["value"], s["unit"]))
    strength = (F.size(said) > 0) & (F.size(recorded) > 0) & ~F.arrays_overlap(said, recorded)
    low = fold("mention")
    forms = F.filter(F.transform(F.concat(F.coalesce("dose_forms", F.array().cast("array<string>")), F.array(F.coalesce("rxterm_form", F.lit("")))), lambda f: normalize_unit(f)), lambda f: f != "")
    cue = F.lit(False)
    for c in FORM_CUES:
        cue = cue | F.contains(low, F.lit(c))
    tight = F.replace(low, F.lit(" "), F.lit(""))
    names = F.coalesce("ingredients", F.array().cast("array<string>"))
    form = (F.size(forms) > 0) & (F.size(names) > 0) & ~F.exists(forms, lambda f: F.contains(tight, f)) & cue
    ingredient = (F.size(names) > 0) & ~F.exists(names, lambda i: F.contains(low, F.substring_index(fold(i), " ", 1)))
    found = F.array_compact(F.array(F.when(strength, "strength_conflict"), F.when(form, "dose_form_conflict"), F.when(ingredient, "ingredient_conflict")))
    return rows.withColumn("conflicts", F.when(F.col("known"), found).otherwise(F.array().cast("array<string>")))


def kb_documents(icd: DataFrame, drugs: DataFrame | None = None) -> DataFrame:
    """row_no, ontology, concept_id, text: the diagnosis concepts, then the drugs, each by id."""
    facts = icd_facts(icd)
    blank = lambda c: F.when(c != "", c)
    names = blank(F.array_join(F.slice("aliases", 1, 4), "; "))
    group = F.when((F.col("parent_label") != "") & ~is_damaged_title("parent_label"), F.concat(F.lit("thuộc nhóm "), "parent_label"))
    rows = facts.select(F.lit("ICD10").alias("ontology"), F.col("code").alias("concept_id"), F.concat_ws(" | ", F.coalesce(blank(F.col("label")), F.col("code")), names, group).alias("text"))
    if drugs is not None:
        first = lambda c: F.get(F.coalesce(c, F.array().cast("array<string>")), F.lit(0))
        made = F.when(F.size("ingredients") > 0, F.concat(F.lit("ingredient "), F.array_join(F.slice("ingredients", 1, 2), "/")))
        strong = F.when(F.size("strengths") > 0, F.concat(F.lit("strength "), F.coalesce(F.get("strengths", F.lit(0))["raw"], F.lit(""))))
        form = F.concat(F.lit("form "), first(F.col("dose_forms")))
        rows = rows.unionByName(drugs.select(F.lit("RXNORM").alias("ontology"), "concept_id", F.concat_ws(" | ", blank(F.col("canonical_name")), made, strong, form).alias("text")))
    order = Window.partitionBy("ontology").orderBy("concept_id")
    sizes = rows.groupBy("ontology").agg(F.count("*").alias("n"))
    before = sizes.agg(F.coalesce(F.max(F.when(F.col("ontology") == "ICD10", F.col("n"))), F.lit(0)).alias("n"))
    rows = rows.withColumn("k", F.row_number().over(order)).crossJoin(F.broadcast(before))  # one row
    return rows.select((F.col("k") - 1 + F.when(F.col("ontology") == "ICD10", 0).otherwise(F.col("n"))).cast("long").alias("row_no"), "ontology", "concept_id", "text")


def preferred_atom(atoms: DataFrame) -> DataFrame:
    """rxcui, rxaui, string of the first atom by (suppressed, not preferred, tty, rxaui)."""
    order = F.struct(is_suppressed(F.col("suppress")).alias("s"), (~F.col("is_pref")).alias("p"), "tty", "rxaui")
    return atoms.groupBy("rxcui").agg(F.min_by(F.struct("rxaui", "string"), order).alias("a")).select("rxcui", "a.*")


def is_suppressed(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit("")).isin("N", "")


def suppressed_concepts(atoms: DataFrame) -> DataFrame:
    """rxcui, suppressed: whether all its atoms are."""
    return atoms.groupBy("rxcui").agg(F.bool_and(is_suppressed(F.col("suppress"))).alias("suppressed"))


def term_types(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("rxcui").agg(F.array_sort(F.collect_set("tty")).alias("ttys"))


def structure_relations(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("rela").isin(*STRUCTURE_RELATIONS))


def attributes(rows: DataFrame, names: list[str]) -> DataFrame:
    """rxcui and one sorted array column for each attribute name."""
    return rows.where(F.col("atn").isin(*names)).groupBy("rxcui").agg(*[F.array_sort(F.collect_set(F.when(F.col("atn") == n, F.col("atv")))).alias(n) for n in names])


def remap_targets(relations: DataFrame, names: tuple[str, ...] = REMAP_RELATIONS) -> DataFrame:
    """rxcui1 and the sorted targets of its remapping relations, one hop."""
    return relations.where(F.col("rela").isin(*names)).groupBy("rxcui1").agg(F.array_sort(F.collect_set("rxcui2")).alias("targets"))
