"""The two pipelines: extraction of entities from notes, and linking of entities to the knowledge base."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assertions, document, facts, lattice, lexicon, linking, models, proposals, resolver, retrieval, retrievers
from .stages import cut


@dataclass(frozen=True)
class Profile:
    """The production settings."""

    use_model: bool = True
    use_verifier: bool = True
    max_options: int = 12
    radius: int = 200
    sparse_top: int = 4
    shortlist: int = 50
    dense_top: int = 4
    cap: int = 10


def collect(docs: DataFrame, seeds: DataFrame | None, phrases: DataFrame | None, responder: Callable | None) -> DataFrame:
    """The pool of proposals from seeds, the model's three passes, and governed phrases."""
    parts = []
    columns = ["doc_id", "seq", "start", "end", "text", "type", "sources", "line_id", "how"]
    source = lambda s: F.array(F.lit(s)).alias("sources")
    columns_of = lambda rows, name, seq: rows.select("doc_id", F.lit(seq).alias("seq"), "start", "end", "text", "type", source(name), F.lit("").alias("line_id"), F.lit("offsets").alias("how"))
    if seeds is not None:
        placed = seeds.where(F.col("type").isin(*proposals.TYPES)).where("0 <= start and start < end and end < 2147483647").select("doc_id", "start", "end", "type")
        placed = document.with_slices(placed, docs, text=("start", "end")).where("length(text) = end - start")  # shorter: beyond the text's end
        parts.append(columns_of(placed, proposals.SEED, 0))
    if responder is not None:
        rows = models.proposals_of(models.ask(models.pass_prompts(docs), responder))
        parts.append(proposals.align(docs, rows).where("reason is null").withColumn("seq", F.col("seq") + 1).select(*columns))
    if phrases is not None:
        hits = lexicon.alias_hits(docs, phrases).withColumn("type", F.col("entity_type"))
        parts.append(columns_of(hits, proposals.ALIAS, 1_000_000))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return proposals.mark_completions(cut(proposals.pool(rows)))  # met three times there


def extract(docs: DataFrame, seeds: DataFrame | None = None, phrases: DataFrame | None = None, responder: Callable | None = None, profile: Profile | None = None) -> DataFrame:
    """doc_id, start, end, text, type, sources, subsumes_seed, assertions, reason of the final entities."""
    profile = profile or Profile()
    pooled = cut(collect(docs, seeds, phrases, responder if profile.use_model else None))
    opts = cut(lattice.options(pooled, docs))
    if responder is None or not profile.use_verifier:
        accepted = lattice.verify_without_model(opts)
    else:
        sizes = opts.groupBy("doc_id", "group_id").agg(F.count("*").alias("n"), F.min((F.col("sources") == F.array(F.lit(proposals.ALIAS))).cast("int")).alias("alone"))
        live = opts.join(sizes, ["doc_id", "group_id"]).where("alone = 0")
        large = live.where(F.col("n") > profile.max_options).where(F.array_contains("sources", proposals.SEED))
        asked = live.where(F.col("n") <= profile.max_options).drop("n", "alone")
        replies = models.ask(models.verification_prompts(asked, docs, profile.radius), responder)
        parsed = replies.select("doc_id", "group_id", models.parse_verdicts("reply", "n_options").alias("v"))
        verdicts = parsed.select("doc_id", "group_id", F.explode("v.rows").alias("r")).select("doc_id", "group_id", "r.*")
        done = lattice.apply_verdicts(asked, verdicts, parsed.where("v.failed")).where("accepted").drop("accepted")
        accepted = done.unionByName(large.drop("n", "alone"))
    accepted = accepted.where(F.col("sources") != F.array(F.lit(proposals.ALIAS)))
    final = cut(resolver.resolve(cut(accepted), docs, document.lines(docs)))
    final = assertions.assertions(final, docs)
    marks = pooled.where("subsumes_seed").select("doc_id", "start", "end", "type", "subsumes_seed")
    final = final.join(marks, ["doc_id", "start", "end", "type"], "left").withColumn("subsumes_seed", F.coalesce("subsumes_seed", F.lit(False)))
    return final.withColumn("reason", resolver.confidence_reason(F.col("sources"), F.col("subsumes_seed"))).select("doc_id", "start", "end", "text", "type", "sources", "subsumes_seed", "assertions", "reason")


def link(entities: DataFrame, docs: DataFrame, concepts: DataFrame, posting_rows: DataFrame, drugs: DataFrame, responder: Callable | None = None, dense: dict[str, DataFrame] | None = None, specs: list[retrievers.Retriever] | None = None, factories: dict | None = None, profile: Profile | None = None) -> DataFrame:
    """entities with candidates, concept_id, decision and reason of the linked types.

    Views are made once for each distinct context, candidates from postings (and vectors), then pruned, put in an order
    without information, chosen by the responder, and kept if independent evidence supports the choice.
    """
    profile = profile or Profile()
    found = document.mention_context(linking.mentions(entities.select("doc_id", "start", "end", "text", "type"), docs), docs)
    found = cut(found.withColumn("mention_id", F.concat_ws(":", "doc_id", "start", "end", "type")))
    prompt = models.reformulation_prompt(F.col("type"), F.col("heading"), F.col("previous_sentence"), F.col("current_sentence"), F.col("next_sentence"), F.col("mention"))
    if responder is None:
        said = found.withColumn("reply", F.lit(None).cast("string"))
    else:
        said = models.ask(found.withColumn("prompt", prompt), responder).drop("prompt", "tokens", "hit_limit")
    vi, en, _ = linking.parse_reformulation(F.col("reply"))
    said = said.select("mention_id", "ontology", "type", "mention", vi.alias("vi"), en.alias("en"))
    views = cut(said.select("mention_id", "ontology", "type", "mention", F.explode_outer(linking.views(F.col("mention"), F.col("vi"), F.col("en"))).alias("v"))).select("mention_id", "ontology", "type", "mention", "v.view", "v.text")
    asked = views.select(F.concat_ws("|", "ontology", "text").alias("query_id"), "ontology", F.col("text").alias("query")).distinct()
    own = lambda o, rows: rows.where(F.col("ontology") == o)
    hits = None
    for o in ("ICD10", "RXNORM"):
        part = retrieval.sparse_search(own(o, asked), own(o, posting_rows), own(o, concepts), profile.sparse_top, profile.shortlist).select("query_id", "concept_id", F.lit("sparse_char_ngram").alias("retriever"), "rank")
        hits = part if hits is None else hits.unionByName(part)
    sparse = views.where(F.col("view").isin("raw", "canonical_vi")).select("mention_id", "view", F.concat_ws("|", "ontology", "text").alias("query_id")).join(hits, "query_id")
    every = cut(sparse).select(F.col("mention_id").alias("query_id"), "concept_id", "retriever", "view", "rank")
    if dense and specs and factories:  # an index of each retriever; the registry says which ontology it may serve
        near = retrievers.dense_hits(views, dense, specs, factories, top=profile.dense_top)
        every = every.unionByName(near.select(F.col("mention_id").alias("query_id"), "concept_id", "retriever", "view", "rank"))
    exact = None
    for o in ("ICD10", "RXNORM"):
        part = retrieval.exact_alias_ids(found.where(F.col("ontology") == o).select(F.col("mention_id").alias("query_id"), F.col("mention").alias("query")), own(o, posting_rows))
        exact = part if exact is None else exact.unionByName(part)
    united = retrieval.capped(retrieval.candidate_union(every, exact), profile.cap).withColumnRenamed("query_id", "mention_id")
    united = united.join(found.select("mention_id", "mention", "type", "ontology"), "mention_id")
    kept = cut(linking.prune(united, concepts, drugs).where("reason is null").drop("reason"))
    opts = cut(linking.option_order(kept))
    if responder is None:
        chosen = found.select("mention_id", F.lit("NONE").alias("decision"), F.lit(None).cast("string").alias("concept_id"))
    else:
        lines = opts.join(found.select("mention_id", "ontology", "type", "current_sentence"), "mention_id")
        shown = facts.candidate_lines(lines.select("mention", "ontology", "concept_id"), concepts, drugs)
        lines = lines.join(shown, ["mention", "ontology", "concept_id"])
        listed = lines.groupBy("mention_id", "mention", "type", "current_sentence").agg(F.array_sort(F.collect_list(F.struct("position", "letter", "lines"))).alias("o"))
        asks = listed.select("mention_id", models.rerank_prompt(F.col("mention"), F.col("type"), F.col("current_sentence"), F.transform("o", lambda x: F.struct(x["letter"].alias("letter"), x["lines"].alias("lines")))).alias("prompt"))
        replies = models.ask(asks, responder).select("mention_id", "reply")
        chosen = linking.parse_selection(replies, opts).select("mention_id", "decision", "concept_id")
    support = kept.select("mention_id", "concept_id", "exact_alias", "retriever_count", "view_count")
    records = found.select("mention_id", "doc_id", "start", "end", "type").join(chosen, "mention_id", "left").join(support, ["mention_id", "concept_id"], "left")
    records = records.withColumn("reason", F.when(F.col("concept_id").isNotNull(), linking.confidence(F.col("exact_alias"), F.col("retriever_count"), F.col("view_count"))))
    records = records.withColumn("candidates", linking.candidates_for("high", F.col("concept_id"), F.col("reason")))
    out = linking.attach(entities, records)
    extra = records.select("doc_id", "start", "end", "type", F.coalesce("decision", F.lit("NONE")).alias("decision"), "concept_id", F.col("reason").alias("link_reason"))
    return out.join(extra, ["doc_id", "start", "end", "type"], "left")
