"""Readers. All return DataFrames; whatever a file lacks is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<text:string,type:string,position:array<int>,assertions:array<string>,candidates:array<string>>"
STRENGTH = "struct<value:string,unit:string,raw:string>"
DRUG = f"rxcui string, name string, tty string, ingredients array<string>, precise_ingredients array<string>, strengths array<{STRENGTH}>, dose_forms array<string>, rxterm_form string, available_strength string"
RRF = {
    "rxnconso": "rxcui string, rxaui string, lat string, tty string, sab string, code string, string string, is_pref boolean, suppress string",
    "rxnrel": "rxcui1 string, rel string, rxcui2 string, rela string, sab string, rui string, suppress string",
    "rxnsat": "rxcui string, atn string, atv string, sab string, suppress string",
    "rxnsty": "rxcui string, tui string, sty string",
}


def _stem():
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: one file a document, named by its stem."""
    return spark.read.text(path, wholetext=True).select(_stem().alias("doc_id"), F.col("value").alias("text"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, end, text, type, assertions, candidates of JSON lists; a file that is no list has none."""
    rows = spark.read.text(path, wholetext=True).select(_stem().alias("doc_id"), F.from_json("value", f"array<{ENTITY}>").alias("e"))
    rows = rows.select("doc_id", F.posexplode("e").alias("idx", "e")).where("e.position is not null and size(e.position) = 2")
    at = lambda k: F.col("e.position")[k].cast("long")
    return rows.select("doc_id", "idx", at(0).alias("start"), at(1).alias("end"), "e.text", "e.type", "e.assertions", "e.candidates")


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """name, content of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def inverted_index(spark: SparkSession, path: str, ontology: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, postings, edges) of one JSON index. Records without an id are dropped; of equal ids the last stays."""
    names = ["exact", "exact_ascii", "ngrams", "sparse_terms", "graph", "exact_canonical", "exact_alias", "exact_synonym", "ngrams_accent", "sparse_accent"]
    channel = {"ngrams": "char_ngram", "sparse_terms": "sparse", "ngrams_accent": "char_ngram_accent"}
    record = "struct<concept_id:string,canonical_name:string,aliases:array<string>,metadata:map<string,string>>"
    schema = f"records array<{record}>, " + ", ".join(f"{n} map<string,array<string>>" for n in names)
    raw = spark.read.schema(schema).json(path, multiLine=True)
    rows = raw.select(F.posexplode("records").alias("k", "r")).select("k", "r.*").where("concept_id is not null and concept_id <> ''")
    concepts = rows.groupBy("concept_id").agg(F.max_by(F.struct("canonical_name", "aliases", "metadata"), "k").alias("r")).select(F.lit(ontology).alias("ontology"), "concept_id", "r.*")
    parts = [raw.select(F.lit(channel.get(n, n)).alias("channel"), F.explode(n).alias("term", "ids")).select(F.lit(ontology).alias("ontology"), "channel", "term", F.explode("ids").alias("concept_id")) for n in names if n != "graph"]
    posting_rows = parts[0]
    for p in parts[1:]:
        posting_rows = posting_rows.unionByName(p)
    edges = raw.select(F.explode("graph").alias("src", "ids")).select(F.lit(ontology).alias("ontology"), "src", F.explode("ids").alias("dst"))
    return concepts, posting_rows, edges


def drugs(spark: SparkSession, path: str) -> DataFrame:
    """Structured drugs of a JSON-lines file; of equal ids one stays."""
    return spark.read.schema(DRUG).json(path).where("rxcui is not null").dropDuplicates(["rxcui"])


def rrf(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One pipe-delimited table of the drug snapshot."""
    return spark.read.schema(RRF[table]).csv(path, sep="|")


def revision_conflicts(pins: DataFrame) -> DataFrame:
    """Keys pinned to more than one revision."""
    return pins.groupBy("key").agg(F.countDistinct("revision").alias("n")).where("n > 1")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
