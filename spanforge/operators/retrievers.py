"""Which dense retriever may serve which ontology, and what they find for a whole corpus of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, retrieval

DIAGNOSIS, DRUG = "diagnosis", "drug"
CLS, MEAN = "cls", "mean"


@dataclass(frozen=True)
class Retriever:
    """An entry of the registry. roles: what it may serve; pooling: how its encoder makes one vector of many."""

    key: str
    roles: tuple[str, ...]
    pooling: str = MEAN
    enabled: bool = True


def role_of(ontology: str) -> str:
    return DIAGNOSIS if ontology == "ICD10" else DRUG


def retrievers_for(specs: list[Retriever], role: str) -> list[Retriever]:
    """Enabled entries of a role, in the registry's order."""
    return [s for s in specs if s.enabled and role in s.roles]


def assert_role(spec: Retriever, ontology: str) -> None:
    if role_of(ontology) not in spec.roles:
        raise ValueError(f"{spec.key} is not declared for {role_of(ontology)}")


def pool(states: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """(texts, dim) from states (texts, tokens, dim): the first token's, or the mean of those that the mask keeps."""
    if pooling == CLS:
        return states[:, 0]
    if pooling != MEAN:
        raise ValueError(f"unknown pooling {pooling}")
    kept = mask[..., None].astype(states.dtype)
    return (states * kept).sum(1) / np.maximum(kept.sum(1), 1e-9)


def encoder_of(spec: Retriever, factories: dict[str, tuple[str, Callable]]) -> Callable:
    """The factory of a retriever's encoder. factories: key to (pooling, factory); there is no general one to fall back on."""
    if spec.key not in factories:
        raise KeyError(f"no encoder for {spec.key}")
    pooling, factory = factories[spec.key]
    if pooling != spec.pooling:
        raise ValueError(f"the encoder of {spec.key} pools by {pooling}, the registry says {spec.pooling}")
    return factory


def dense_hits(queries: DataFrame, indexes: dict[str, DataFrame], specs: list[Retriever], factories: dict[str, tuple[str, Callable]], ontologies: tuple[str, ...] = ("ICD10", "RXNORM"), views: tuple[str, ...] = ("raw", "canonical_vi", "canonical_en"), top: int = 4) -> DataFrame:
    """(mention_id, concept_id, retriever, view, rank) of queries(mention_id, ontology, view, text).

    Every distinct text is encoded once for each retriever that may serve its ontology; views that the policy leaves out
    are not asked.
    """
    asked = queries.where(F.col("view").isin(*views)).withColumn("query_id", F.concat_ws("|", "ontology", "text"))
    distinct, parts = asked.select("query_id", "ontology", "text").distinct(), []
    for ontology in ontologies:
        for spec in retrievers_for(specs, role_of(ontology)):
            if spec.key in indexes:
                assert_role(spec, ontology)
                own = lambda df, o=ontology: df.where(F.col("ontology") == o)
                vectors = models.encode(own(distinct), encoder_of(spec, factories)).select("query_id", "ontology", "vec")
                found = retrieval.dense_topk(vectors, own(indexes[spec.key]), top)
                parts.append(found.select("query_id", "concept_id", F.lit(spec.key).alias("retriever"), "rank"))
    if not parts:
        return asked.select("mention_id", F.lit("").alias("concept_id"), F.lit("").alias("retriever"), "view", F.lit(0).cast("long").alias("rank")).limit(0)
    return asked.select("mention_id", "view", "query_id").join(reduce(DataFrame.unionByName, parts), "query_id").select("mention_id", "concept_id", "retriever", "view", "rank")
