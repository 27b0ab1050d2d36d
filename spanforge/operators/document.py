"""Document structure: lines, tokens, sentences, sections, clauses, occurrences. All offsets are half-open code points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, fold, let, line_id, running, upto

# Where a sentence and a clause end, and what a heading looks like.
SENTENCE_END = rf"(?<=[.!?;]){SPACE}+|\n+"
CLAUSE_END = r"[,;.:\n()\[\]]|(?<![\p{L}\p{N}_])(?:nhưng|còn|mà|tuy nhiên)(?![\p{L}\p{N}_])"
HEADING = r"^[ \t\x{0B}\f\r]*([^:\n]{2,60}):[ \t\x{0B}\f\r]*(.*)$"
#: Code points of the pieces that slices are taken from.
PIECE = 512
# Headings of the patient's own and of the family's history.
HISTORY_HEADINGS = ("tiền sử", "tiền căn", "bệnh sử", "quá trình bệnh lý", "tiền sử bệnh")
FAMILY_HEADINGS = ("tiền sử gia đình", "gia đình")


def slice_of(text: Column | str, start: Column | str, end: Column | str) -> Column:
    at = lambda x: F.col(x) if isinstance(x, str) else x
    return F.substring(at(text), (at(start) + 1).cast("int"), (at(end) - at(start)).cast("int"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line_id, start, end, text; empty lines are kept."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "text"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    number = F.col("k") + 1
    return parts.select("doc_id", number.cast("long").alias("line_no"), line_id(number).alias("line_id"), "start", (F.col("start") + F.length("text")).alias("end"), "text")


def render(text: Column | str) -> Column:
    """`L001| text` for each line that is not blank."""
    rows = F.transform(F.split(text, "\n", -1), lambda t, k: F.struct(line_id(k + 1).alias("id"), t.alias("t")))
    return F.array_join(F.transform(F.filter(rows, lambda r: F.length(F.regexp_replace(r["t"], f"{SPACE}+", "")) > 0), lambda r: F.concat(r["id"], F.lit("| "), r["t"])), "\n")


def matches(docs: DataFrame, regex: str, kind: str = "hit") -> DataFrame:
    """doc_id, pos, text, start, end of each match: gaps and matches add up to the places."""
    both = F.arrays_zip(F.split("text", regex, -1).alias("gap"), F.regexp_extract_all(F.col("text"), F.lit(regex), F.lit(0)).alias("hit"))
    rows = docs.select("doc_id", F.posexplode(both).alias("pos", "x")).select("doc_id", "pos", "x.gap", "x.hit")
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("gap") + F.coalesce(F.length("hit"), F.lit(0))
    rows = rows.withColumn("done", F.sum(size).over(upto))
    if kind == "gap":
        end = F.col("done") - F.coalesce(F.length("hit"), F.lit(0))
        return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("gap").alias("text"), (end - F.length("gap")).alias("start"), end.alias("end"))
    return rows.where("hit is not null").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("hit").alias("text"), (F.col("done") - F.length("hit")).alias("start"), F.col("done").alias("end"))


def tokens_at(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text, start, end, folded."""
    return matches(docs, WORD).withColumn("folded", fold("text"))


def word_sums(w: Column, g: Column) -> Column:
    """For upto(): the ends of the words w of a text with g before, between and after them."""
    return running(F.transform(F.arrays_zip(g.alias("g"), w.alias("w")), lambda x: (F.length(x["g"]) + F.coalesce(F.length(x["w"]), F.lit(0))).cast("long")))


def words_at(docs: DataFrame, keep) -> DataFrame:
    """doc_id, pos, text, start, end of the words for which keep(word) holds; the others are not shuffled."""
    lists = docs.select("doc_id", F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)).alias("w"), F.split("text", WORD, -1).alias("g"))
    lists = lists.where(F.exists("w", keep)).select("doc_id", "w", word_sums(F.col("w"), F.col("g")).alias("sums"))

    def place(x: Column, k: Column) -> Column:
        end = upto(F.col("sums"), k)
        return F.when(keep(x), F.struct(k.cast("long").alias("pos"), x.alias("text"), (end - F.length(x)).alias("start"), end.alias("end")))

    found = F.filter(F.transform("w", place), lambda x: x.isNotNull())
    return lists.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def gaps_ahead(docs: DataFrame, ahead, most: int) -> DataFrame:
    """doc_id, pos, gap: the text from each word's end to the start of the word ahead(word) places on (1 to most).

    Words without such a word have no row, nor has a null doc_id. Each word comes with the next words and what lies
    between them, from the lists of its document: no word is shuffled, and no text is counted through for a slice.
    """
    lists = docs.where("doc_id is not null").select("doc_id", F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)).alias("w"), F.split("text", WORD, -1).alias("g"))
    shifted = lambda c, k: F.slice(c, k + 1, 1 << 30) if k else F.col(c)
    both = F.arrays_zip(*[shifted(c, k).alias(f"{c}{k}") for k in range(most + 1) for c in ("w", "g") if k or c == "w"])
    rows = lists.select("doc_id", F.posexplode(both).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), "x.*")
    n, gap = ahead(F.col("w0")), F.lit(None).cast("string")
    for k in range(1, most + 1):
        upto = F.concat(*[F.col(f"{c}{j}") for j in range(1, k + 1) for c in ("g", "w")][:-1])
        gap = F.when((n == k) & F.col(f"w{k}").isNotNull(), upto).otherwise(gap)
    return rows.select("doc_id", "pos", gap.alias("gap")).where("gap is not null")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text, start, end; empty ones are skipped."""
    rows = matches(docs, SENTENCE_END, "gap").where("end > start")
    order = Window.partitionBy("doc_id").orderBy("start")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def as_of(spans: DataFrame, rows: DataFrame, at: str = "start", prefix: str = "") -> DataFrame:
    """spans with the columns of the last of rows (doc_id, start, ...) that starts at or before the offset in the document.

    One sort of both by document and place; no pair of a span and a row is made but the one that counts. Spans of a null
    doc_id find nothing.
    """
    names = [c for c in rows.columns if c != "doc_id"]
    one, row = F.struct(*[spans[c] for c in spans.columns]), F.struct(*[F.col(c).alias(prefix + c) for c in names])
    left = spans.select("doc_id", F.col(at).cast("long").alias("__at"), F.lit(1).alias("__kind"), one.alias("__span"))
    right = rows.select("doc_id", F.col("start").cast("long").alias("__at"), F.lit(0).alias("__kind"), row.alias("__row"))
    both = left.unionByName(right, allowMissingColumns=True)
    upto = Window.partitionBy("doc_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.when(F.col("doc_id").isNotNull(), F.last("__row", ignorenulls=True).over(upto))
    return both.withColumn("__row", last).where("__kind = 1").select("__span.*", "__row.*")


def with_slices(rows: DataFrame, docs: DataFrame, **spans: tuple[str, str]) -> DataFrame:
    """rows with the texts between two offsets, name=(start, end). A document's text meets its rows once, gathered.

    The text is cut into pieces of equal length first, so that a slice is not counted out from the start of the text.
    Rows without a document are dropped.
    """
    taken = [c for c in rows.columns if c not in spans]
    gathered = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*taken)).alias("__rows"))

    def piece(pieces: Column, a: Column, b: Column) -> Column:
        first, last = (F.floor(x / PIECE).cast("int") for x in (a, b - 1))
        text = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(b <= a, "").otherwise(F.substring(text, (a % PIECE + 1).cast("int"), (b - a).cast("int")))

    cut = lambda p: F.transform("__rows", lambda r: F.struct(*[r[c].alias(c) for c in taken], *[piece(p, r[a], r[b]).alias(n) for n, (a, b) in spans.items()]))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    met = gathered.join(docs.select("doc_id", "text"), "doc_id")
    return met.select(F.explode(let(pieces, cut)).alias("__r")).select("__r.*")


def line_of(spans: DataFrame, line_rows: DataFrame, at: str = "start") -> DataFrame:
    """spans with line_no, line_id, line_start of the line that reaches the offset (its end included)."""
    found = as_of(spans, line_rows.select("doc_id", "line_no", "line_id", "start", "end"), at, "__l_")
    inside = F.col(at) <= F.col("__l_end")
    return found.select(*spans.columns, *[F.when(inside, F.col(f"__l_{c}")).alias(n) for c, n in (("line_no", "line_no"), ("line_id", "line_id"), ("start", "line_start"))])


def _any(text: Column, cues: tuple[str, ...]) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(c) for c in cues) + ")")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, heading, start, end, is_history, is_family: a heading governs up to the next, or the end of the text."""
    heads = lines(docs).where(F.col("text").rlike(HEADING))
    order = Window.partitionBy("doc_id").orderBy("start")
    heads = heads.select("doc_id", F.trim(F.regexp_extract("text", HEADING, 1)).alias("heading"), "start", F.lead("start").over(order).alias("next"))
    sizes = docs.select("doc_id", F.length("text").cast("long").alias("size"))
    name = fold("heading")
    return heads.join(sizes, "doc_id").select("doc_id", "heading", "start", F.coalesce("next", "size").alias("end"), _any(name, HISTORY_HEADINGS).alias("is_history"), _any(name, FAMILY_HEADINGS).alias("is_family"))


def with_section(spans: DataFrame, section_rows: DataFrame) -> DataFrame:
    """spans with heading, is_history, is_family of the section that holds their start (null and false outside)."""
    found = as_of(spans, section_rows.select("doc_id", "heading", "start", "end", "is_history", "is_family"), "start", "__s_")
    inside, no = F.col("start") < F.col("__s_end"), F.lit(False)
    flags = [F.coalesce(F.when(inside, F.col(f"__s_{c}")), no).alias(c) for c in ("is_history", "is_family")]
    return found.select(*spans.columns, F.when(inside, F.col("__s_heading")).alias("heading"), *flags)


def with_clause(spans: DataFrame, docs: DataFrame, left: str = "clause_start", right: str = "clause_end") -> DataFrame:
    """spans with the bounds of their clause: after the last break before them, up to the first after them.

    The breaks of a document are found once, whatever the number of its spans.
    """
    breaks = matches(docs, CLAUSE_END).select("doc_id", F.col("start").alias("b"), F.col("end").alias("e"))
    # a break counts from its end for what follows, and up to its start for what goes before
    before = as_of(spans, breaks.select("doc_id", F.col("e").alias("start")), "start", "__b_")
    sizes = docs.select("doc_id", (-F.length("text")).cast("long").alias("start"))
    turned = before.withColumn("__turned", -F.col("end"))
    after = as_of(turned, breaks.select("doc_id", (-F.col("b")).alias("start")).unionByName(sizes), "__turned", "__a_")
    return after.select(*spans.columns, F.coalesce("__b_start", F.lit(0)).cast("long").alias(left), (-F.col("__a_start")).cast("long").alias(right))


def cue_regex(cues: tuple[str, ...]) -> str:
    """One alternation: the leftmost match, and at one place the first of the list, between word ends.

    The first letters are looked at before all else: most places have none of them.
    """
    first = "".join(re.escape(c) for c in sorted({c[0] for c in cues}))
    return rf"(?=[{first}])(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(re.escape(c) for c in cues)})(?![\p{{L}}\p{{N}}_])"


def cue_in(folded: Column, cues: tuple[str, ...]) -> Column:
    """The earliest cue of a folded text, or ''."""
    return F.regexp_extract(folded, cue_regex(cues), 0)


def place_of(folded: Column, cue: Column, cues: tuple[str, ...]) -> Column:
    """The place of what cue_in() found, or -1."""
    return F.when(cue == "", F.lit(-1)).otherwise(F.length(F.element_at(F.split(folded, cue_regex(cues), 2), 1))).cast("long")


def first_cue(text: Column, cues: tuple[str, ...]) -> tuple[Column, Column]:
    """(cue or '', place or -1) of the earliest cue in the folded text."""
    cue = cue_in(fold(text), cues)
    return cue, place_of(fold(text), cue, cues)


def occurrences(text: Column, needle: Column) -> Column:
    """Starts of all occurrences, overlapping ones too; none of an empty needle."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    # the text is cut before every occurrence, so all pieces but perhaps the first begin with one
    starts = F.aggregate(F.split(text, quoted, -1), zero, step, lambda acc: acc["out"])
    none = F.array().cast("array<int>")
    return F.when((F.length(needle) > 0) & F.contains(text, needle), F.when(F.startswith(text, needle), starts).otherwise(F.slice(starts, 2, 1 << 30))).otherwise(none)


def mention_context(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans with previous, current and next sentence and the heading of their section."""
    order = Window.partitionBy("doc_id").orderBy("start")
    s = sentences(docs).select("doc_id", "start", "end", F.trim("text").alias("current_sentence"), F.trim(F.lag("text").over(order)).alias("previous_sentence"), F.trim(F.lead("text").over(order)).alias("next_sentence"))
    found = as_of(spans, s, "start", "__s_")
    inside, blank = F.col("start") < F.col("__s_end"), F.lit("")
    said = [F.coalesce(F.when(inside, F.col(f"__s_{c}")), blank).alias(c) for c in ("previous_sentence", "current_sentence", "next_sentence")]
    return with_section(found.select(*spans.columns, *said), sections(docs)).withColumn("heading", F.coalesce("heading", blank)).drop("is_history", "is_family")
