"""Retrieval: postings search with evidence tiers, n-gram similarity, dense top-k, and candidate union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accent_marked, char_ngrams, normalize_text, tokens

# Points of a match, and the tier that each channel is evidence of (1 the strongest).
POINTS = {"exact": 100, "exact_canonical": 100, "exact_alias": 100, "exact_synonym": 100, "exact_ascii": 80, "sparse": 2, "sparse_accent": 2, "char_ngram": 1, "char_ngram_accent": 1}
TIERS = {"exact_canonical": 1, "exact": 1, "exact_alias": 2, "exact_synonym": 3, "sparse_accent": 4, "char_ngram_accent": 4, "exact_ascii": 5, "sparse": 6, "char_ngram": 6}
EXACT = ("exact", "exact_canonical", "exact_alias", "exact_synonym", "exact_ascii")
ALIASES = ("exact_alias", "exact_synonym")
UNTIERED = 7
SHORTLIST, TOP = 50, 4
CAP, RRF = 10, 60


def query_terms(queries: DataFrame, tiered: bool = False) -> DataFrame:
    """(query_id, channel, term, n): n counts repeated tokens, which score again."""
    q = F.col("query")
    parts = {"exact_ascii": F.array(normalize_text(q, True)), "char_ngram": char_ngrams(q), "sparse": tokens(q)}
    if tiered:
        parts |= {c: F.array(normalize_text(q)) for c in ("exact_canonical", "exact_alias", "exact_synonym")}
        parts |= {"char_ngram_accent": accent_marked(char_ngrams(q, strip_accents=False)), "sparse_accent": accent_marked(tokens(q, False))}
    else:
        parts["exact"] = F.array(normalize_text(q))
    mark = lambda c: (lambda x: F.struct(F.lit(c).alias("channel"), x.alias("term")))
    terms = F.concat(*[F.transform(t, mark(c)) for c, t in parts.items()])
    return queries.select("query_id", F.explode(terms).alias("t")).groupBy("query_id", "t.channel", "t.term").agg(F.count("*").alias("n"))


def _of(channel: Column, table: dict[str, int], default: int | None = None) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(channel == name, value).otherwise(out)
    return out


def evidence(queries: DataFrame, posting_rows: DataFrame, edges: DataFrame | None = None, tiered: bool = False) -> DataFrame:
    """query_id, concept_id, score, channels, tier, exactness, alias_support, hierarchy of every match."""
    hits = query_terms(queries, tiered).join(posting_rows.select("channel", "term", "concept_id"), ["channel", "term"])
    c = F.col("channel")
    hits = hits.groupBy("query_id", "concept_id", "channel").agg(F.sum(F.col("n") * _of(c, POINTS, 0)).alias("points"))
    found = hits.groupBy("query_id", "concept_id").agg(
        F.sum("points").cast("long").alias("score"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        (F.min(_of(c, TIERS)) if tiered else F.lit(UNTIERED)).cast("long").alias("tier"),
        F.max(F.when(c.isin(*EXACT), 1).otherwise(0)).cast("long").alias("exactness"),
        F.sum(F.when(c.isin(*ALIASES), 1).otherwise(0)).cast("long").alias("alias_support"),
    )
    if edges is None or not tiered:
        return found.withColumn("hierarchy", F.lit(0).cast("long"))
    near = found.select("query_id", F.col("concept_id").alias("src")).join(edges.select("src", "dst").distinct(), "src").join(found.select("query_id", F.col("concept_id").alias("dst")), ["query_id", "dst"], "left_semi").groupBy("query_id", F.col("src").alias("concept_id")).agg(F.count("*").alias("hierarchy"))
    return found.join(near, ["query_id", "concept_id"], "left").withColumn("hierarchy", F.coalesce("hierarchy", F.lit(0)))


def search(queries: DataFrame, posting_rows: DataFrame, limit: int = 20, edges: DataFrame | None = None, tiered: bool = False) -> DataFrame:
    """The best concepts of each query with rank from 1: tier, exactness, alias support, score, neighbours, id."""
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("exactness"), F.desc("alias_support"), F.desc("score"), F.desc("hierarchy"), "concept_id")
    return evidence(queries, posting_rows, edges, tiered).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def exact_alias_ids(queries: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """(query_id, concept_id) whose whole normalised form is the query's."""
    exact = posting_rows.where(F.col("channel").isin("exact", "exact_canonical", "exact_alias", "exact_synonym")).select("term", "concept_id").distinct()
    return queries.select("query_id", normalize_text("query").alias("term")).join(exact, "term").select("query_id", "concept_id").distinct()


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / total)


def sparse_search(queries: DataFrame, posting_rows: DataFrame, concepts: DataFrame, top: int = TOP, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, concept_id, similarity, shortlist_rank, rank: a shortlist reranked by n-gram similarity of surface forms."""
    short = search(queries, posting_rows, shortlist).select("query_id", "concept_id", F.col("rank").alias("shortlist_rank"))
    names = F.filter(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    forms = concepts.select("concept_id", F.explode(names).alias("form")).select("concept_id", char_ngrams("form").alias("grams"))
    asked = queries.select("query_id", char_ngrams("query").alias("asked"))
    scored = short.join(forms, "concept_id").join(asked, "query_id").groupBy("query_id", "concept_id", "shortlist_rank").agg(F.max(dice(F.col("asked"), F.col("grams"))).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "shortlist_rank", "concept_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(queries: DataFrame, vectors: DataFrame, top: int = 10, max_queries: int = 20000) -> DataFrame:
    """query_id, concept_id, score, rank among vectors of the query's ontology, by dot product of unit vectors.

    queries(query_id, ontology, vec), vectors(concept_id, ontology, vec). The queries are a stated set against all rows:
    they are dealt in blocks, each small enough to send to every task, and the ranks are cut in each task first.
    """
    n = queries.count()
    blocks = -(-n // max_queries) or 1
    out = None
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else queries
        hits = vectors.select("concept_id", "ontology", F.col("vec").alias("__v")).join(F.broadcast(part.select("query_id", "ontology", F.col("vec").alias("__q"))), "ontology")
        hits = hits.select("query_id", "concept_id", dot(F.col("__q"), F.col("__v")).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id")
        hits = hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        out = hits if out is None else out.unionByName(hits)
    return out


def mean_pool(vectors: Column) -> Column:
    """Mean of an array of equal-length vectors."""
    zero = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    return F.transform(F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / F.size(vectors))


def candidate_union(hits: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """hits(query_id, concept_id, retriever, view, rank) as one row a candidate; exact ids only mark what was found."""
    rows = hits.groupBy("query_id", "concept_id").agg(F.countDistinct("retriever").alias("retriever_count"), F.countDistinct("view").alias("view_count"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("retriever")).alias("retrievers"))
    if exact is None:
        return rows.withColumn("exact_alias", F.lit(False))
    marks = exact.select("query_id", "concept_id").distinct().withColumn("exact_alias", F.lit(True))
    return rows.join(marks, ["query_id", "concept_id"], "left").withColumn("exact_alias", F.coalesce("exact_alias", F.lit(False)))


def capped(candidates: DataFrame, cap: int = CAP) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("exact_alias").cast("int")), F.desc("retriever_count"), F.desc("view_count"), "best_rank", "concept_id")
    return candidates.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= cap)


def fuse(hits: DataFrame, governed: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """Reciprocal-rank fusion: query_id, concept_id, score, position."""
    if governed is not None:
        hits = hits.join(governed.select("concept_id").distinct(), "concept_id", "left_semi")
    rows = hits.groupBy("query_id", "concept_id", "retriever").agg(F.min("rank").alias("rank")).groupBy("query_id", "concept_id").agg(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "concept_id")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= cap)
