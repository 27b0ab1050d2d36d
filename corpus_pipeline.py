"""The corpus pipeline: language, near duplicates, benchmark passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import decontamination, language, mixing, ngram_join, tokens
from spanforge.llm.common import Scratch, table, without_ids

#: A document is rejected if its best language is less likely than so many times an even share of all, or without a letter.
OVER_EVEN = 1.1


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay."""
    model = language.fit(spark, docs)
    said = language.with_language(spark, docs, model, fit_on=docs, names=("__lang", "__score"))
    least = min(0.9, OVER_EVEN / max(1, len(model[0]))) if model else 0.0
    return said.where((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; of its repeated rows one
    (rows of one doc_id with other texts stay)."""
    work = Scratch(spark, "ngrams")
    found = Scratch(spark, "groups").table(ngram_join.near_duplicates(spark, docs, scratch=work), "found")
    work.drop()
    out = without_ids(spark, docs, found.where("component_id <> doc_id").select("doc_id").distinct())
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return out
    once = out.where("doc_id is not null").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).select(*docs.columns)
    return once.union(out.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item within its edit budget stay."""
    return decontamination.without_matches(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fitted rate rounds to one stay: rates aim at no toxic tokens and at all others."""
    model = mixing.fit_classifier(spark, docs, table(spark, sf_dir, "labels"))
    judged = mixing.with_posteriors(spark, docs, model)
    members = Scratch(spark, "mixture").table(judged.select("n_tokens", *[f"p_{d}" for d in mixing.DOMAINS]), "members")
    rate, _ = mixing.fit_rates(members, mixing.clean_targets(members), most=1.0)
    return judged.where(mixing.copies_of(rate, "nearest") > 0).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-shuffled blocks; returns what was stored of each document."""
    return tokens.tokens_of(spark, docs)


STAGES = [("language_id", languages), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminated), ("target_mixing", mixed), ("token_output", token_ids)]

#: A trained network, a fitted classifier and a tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
