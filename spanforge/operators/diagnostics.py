"""Counters of a run. A counter is a (name, amount) row; sums of them are a monoid, so partial sums are safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .proposals import ALIAS, MODEL, SEED


def counters(*parts: DataFrame) -> DataFrame:
    """counter, n of (counter, n) rows of several operators."""
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("counter").agg(F.sum("n").alias("n"))


def count_of(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    key = F.lit(name) if by is None else F.concat(F.lit(f"{name}_"), F.col(by))
    return rows.groupBy(key.alias("counter")).agg(F.count("*").alias("n"))


def source_bucket(sources: Column) -> Column:
    """Which source alone found an entity, or agreement of several."""
    return F.when(F.size(sources) > 1, "agreement").when(F.array_contains(sources, SEED), "e3_only").when(F.array_contains(sources, MODEL), "qwen_only").when(F.array_contains(sources, ALIAS), "alias_only").otherwise("other")


def by_source(entities: DataFrame) -> DataFrame:
    return entities.groupBy(source_bucket(F.col("sources")).alias("bucket")).agg(F.count("*").alias("n"))


def by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def mean_union_size(candidates: DataFrame) -> DataFrame:
    """mentions, candidates and their ratio."""
    sizes = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("mentions"), F.sum("n").alias("candidates"), F.avg("n").alias("mean_union_size"))
