"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Seeds are the spans of four fixed expressions. They, and every other word with a digit or an @, are the instances of a
graph; the words at their left and right are its patterns. Spark scores the graph in a few rounds: a pattern is as sure
as the mean score of the distinct instances that it surrounds, where a seed counts 1 and an unseen instance its score so
far; an unseen instance is worth its surest pattern times how far its shape is like the shapes of the kind's seeds. What
ends over the threshold is added.

Shapes are soft: digits and letters become 9 and a, runs become two signs, and likeness is the share of the pairs of
neighbouring signs that enough seeds of the kind have as well. So an address without a dot, or a number with a letter in
it, can be found where its context is sure.

Each expression is used in a form without backtracking that finds the same spans: a repeat that nothing can follow is
possessive, and a search never starts inside a run in which it has failed already. Places add up in blocks of BLOCK
hits, so a text of many hits costs little more than its length.

Defined results: null and empty texts have no spans; repeated rows each give a row; an empty table gives no rows; extra
columns are ignored; spans of different kinds may overlap, added spans never overlap a base span; of kinds with equal
scores the one listed first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import NOT_WS, Scratch, table

KINDS = ("email", "ip", "card", "phone")
#: The base expressions, each equal in its matches to the plain form in the comment.
EXPRESSIONS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text holds if the expression can match at all; cheaper to test.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A word with a digit or an @, up to its last letter, digit or @.
CANDIDATE = rf"(?<!{NOT_WS}){NOT_WS}*[0-9@](?:{NOT_WS}*[\p{{L}}\p{{N}}])?"
#: Signs at each side of an instance in which its context words are looked for.
BESIDE = 120
#: Hits whose places are added up at a time.
BLOCK = 256

_HITS = "array<struct<start:int,end:int,text:string,left:string,right:string>>"
_SPANS = "array<struct<start:int,end:int>>"


def found(text: Column, regex: str) -> Column:
    """All matches with code-point offsets and the words beside them (up to two at the left, one at the right)."""
    flat = lambda gap: F.lower(F.translate(gap, "\t\n\x0b\f\r", "     "))
    beside = lambda gap: F.struct(F.length(gap).alias("n"), F.substring_index(F.rtrim(flat(F.substring(gap, -BESIDE, BESIDE))), " ", -2).alias("last"), F.substring_index(F.ltrim(flat(F.substring(gap, 1, BESIDE))), " ", 1).alias("first"))
    one = lambda at, gap, hit, after: F.struct(
        (at + gap["n"]).cast("int").alias("start"), (at + gap["n"] + F.length(hit)).cast("int").alias("end"), hit.alias("text"), gap["last"].alias("left"), after["first"].alias("right")
    )
    step = lambda acc, x: F.struct((acc["at"] + x["gap"]["n"] + F.length(x["hit"])).cast("int").alias("at"), F.concat(acc["out"], F.array(one(acc["at"], x["gap"], x["hit"], x["after"]))).alias("out"))
    zero = lambda at: F.struct(at.alias("at"), F.array().cast(_HITS).alias("out"))
    block = lambda rows, acc, k: F.aggregate(F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)), zero(acc["at"]), step)
    add = lambda acc, part: F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"))
    blocks = lambda rows: F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    whole = lambda rows: F.aggregate(blocks(rows), zero(F.lit(0)), lambda acc, k: let(block(rows, acc, k), lambda part: add(acc, part)), lambda acc: acc["out"])
    zipped = lambda gaps, hits: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(hits)).alias("after"))
    some = lambda hits: let(F.transform(F.split(text, regex, -1), beside), lambda gaps: let(zipped(gaps, hits), whole))
    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, some(hits)).otherwise(F.array().cast(_HITS)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds: from the right every second digit counts twice, less nine if over nine."""
    at = F.split(F.reverse(digits), "")
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(F.filter(at, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def keeps(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?){3}$")
    size = F.length(_digits(text))
    if kind == "card":
        return F.when(size.between(13, 19), _luhn(_digits(text))).otherwise(F.lit(False))
    return size.between(9, 15)


def _keeper(kind: str):
    return lambda x: keeps(kind, x["text"])


def base_spans(text: Column) -> dict[str, Column]:
    out = {}
    for kind in KINDS:
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
        hits = F.filter(found(text, EXPRESSIONS[kind]), _keeper(kind))
        out[kind] = F.when(may, hits).otherwise(F.array().cast(_HITS))
    return out


def _said(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def shape_pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring signs of a text's shape, its ends included."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[0-9]", "9"), r"\p{L}", "a"), r"(.)\1+", "$1$1")
    return let(F.concat(F.lit("^"), shape, F.lit("$")), lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, 2))))


def _patterns() -> Column:
    """The lexical patterns of an occurrence: the word at its left, the two there, the word at its right, both sides."""
    last = F.substring_index("left", " ", -1)
    some = [
        F.when(last != "", F.concat(F.lit("l "), last)),
        F.when(F.contains("left", F.lit(" ")), F.concat(F.lit("ll "), F.col("left"))),
        F.when(F.col("right") != "", F.concat(F.lit("r "), F.col("right"))),
        F.when((last != "") & (F.col("right") != ""), F.concat_ws(" ", F.lit("lr"), last, "right")),
    ]
    return F.filter(F.array(*some), lambda p: p.isNotNull())


def extract(spark: SparkSession, docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5, threshold: float = 0.6, common: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, base spans by kind) and the added spans (row, kind, start, end, text, score).

    confidence: the least score of a pattern. support: the least number of different seeds that it must surround.
    threshold: the least score of an added instance. common: the share of a kind's seeds that must have a pair of signs.
    """
    scratch = Scratch(spark, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    words = F.when(F.col("text").rlike("[0-9@]"), found(F.col("text"), CANDIDATE)).otherwise(F.array().cast(_HITS))
    spans = base_spans(F.col("text"))
    rows = rows.select("doc_id", *[spans[k].alias(k) for k in KINDS], words.alias("words"))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    of_kind = lambda spans, kind: F.transform(spans, lambda x: x.withField("kind", F.lit(kind).cast("string")))
    every = F.concat(*[of_kind(k, k) for k in KINDS], of_kind("words", None))
    seen = rows.select("row", F.explode(every).alias("w")).select("row", "w.*")
    # words that touch a base span are not instances of their own
    running = lambda *by: Window.partitionBy("row").orderBy(*by, F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = lambda c: F.when(F.col("kind").isNotNull(), F.col(c))
    before, after = F.max(base("end")).over(running("start")), F.min(base("start")).over(running(F.desc("start")))
    free = (F.coalesce(F.col("before"), F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    seen = seen.withColumn("before", before).withColumn("after", after).where(F.col("kind").isNotNull() | free).drop("before", "after")
    seen = scratch.table(seen, "seen")

    edges = seen.select("text", "kind", F.explode(_patterns()).alias("pattern")).groupBy("pattern", "text").agg(F.min("kind").alias("kind"))
    edges = scratch.table(edges, "edges")
    seeds = scratch.table(seen.where("kind is not null").groupBy("text").agg(F.min("kind").alias("kind")), "seeds")
    # pairs of signs that are usual for a kind: a few hundred rows
    counts = seeds.groupBy("kind").agg(F.count("*").alias("all"))
    usual = seeds.select("kind", F.explode(shape_pairs(F.col("text"))).alias("pair")).groupBy("kind", "pair").agg(F.count("*").alias("n")).join(counts, "kind").where(F.col("n") >= common * F.col("all")).select("kind", "pair")
    # candidates: unseen instances in a pattern that enough seeds of a kind have
    wide = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("wide")).where(F.col("wide") >= support).select("pattern", "kind")
    wide = scratch.table(wide, "wide")
    links = scratch.table(edges.withColumnRenamed("kind", "own").join(wide, "pattern"), "links")
    asked = links.where("own is null").select("text", "kind").distinct().withColumn("pair", F.explode(shape_pairs(F.col("text"))))
    like = asked.join(F.broadcast(usual.withColumn("hit", F.lit(1))), ["kind", "pair"], "left").groupBy("text", "kind").agg((F.count("hit") / F.count("*")).alias("like"))
    like = scratch.table(like.where(F.col("like") >= threshold), "like")
    scores = like.select("text", "kind", F.lit(0.0).alias("score"))
    for k in range(rounds):
        worth = F.when(F.col("own") == F.col("kind"), 1.0).when(F.col("own").isNotNull(), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
        sure = links.join(scores, ["text", "kind"], "left").groupBy("pattern", "kind").agg(F.avg(worth).alias("p")).where(F.col("p") >= confidence)
        best = links.where("own is null").select("pattern", "text", "kind").join(sure, ["pattern", "kind"]).groupBy("text", "kind").agg(F.max("p").alias("p"))
        scores = scratch.table(best.join(like, ["text", "kind"]).select("text", "kind", (F.col("p") * F.col("like")).alias("score")), f"scores-{k}")
    place = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, -k)]), F.col("kind"))
    best = scores.where(F.col("score") >= threshold).groupBy("text").agg(F.max(F.struct("score", place.alias("place"), "kind")).alias("best"))
    best = scratch.table(best.select("text", "best.kind", "best.score"), "best")
    extra = seen.where("kind is null").drop("kind").join(best, "text").select("row", "kind", "start", "end", "text", "score")
    return rows.drop("words"), extra


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, extra = extract(spark, table(spark, sf_dir, "documents"))
    more = extra.groupBy("row").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end"))).alias(f"more_{k}") for k in KINDS])
    rows = rows.join(more, "row", "left")
    places = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast(_SPANS)
    every = F.concat(*[_said(k, F.array_sort(F.concat(places(k), F.coalesce(F.col(f"more_{k}"), none)))) for k in KINDS])
    base = F.concat(*[_said(k, F.col(k)) for k in KINDS])
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
