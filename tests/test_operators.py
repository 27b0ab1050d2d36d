"""Literal cases of the operators."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import assertions, document, lattice, lexicon, linking, models, proposals, resolver, validation
from spanforge.plans import pipeline


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.normalize_text(F.lit("  Viêm  PHỔI "), True)) == "viem phoi"
    assert one(spark, T.tokens(F.lit("Đau đầu, sốt_1"), False)) == ["đau", "đầu", "sốt_1"]
    assert one(spark, T.char_ngrams(F.lit("sởi"), strip_accents=False)) == sorted(["  s", " sở", "sởi", "ởi ", "i  "])
    assert [s["key"] for s in one(spark, T.strengths(F.lit("a 0.50 MG, 12,5 mg / 5 ML")))] == ["0.5mg", "12.5mg", "5ml"]
    assert one(spark, T.to_dotted(F.lit("J189"))) == "J18.9"
    assert one(spark, T.line_id(F.lit(1234))) == "L1234"
    assert one(spark, document.occurrences(F.lit("aaab"), F.lit("aa"))) == [0, 1]


def test_ngrams_of_a_long_text(spark):
    assert one(spark, T.char_ngrams(F.lit("é😀b é"), strip_accents=False, marked=True)) == sorted(["  é", " é😀", "é😀b", "b é", " é ", "é  "])
    plain = lambda v: sorted({v[i : i + 3] for i in range(len(v) - 2)})
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeghiklmnorstéüñđở😀") for _ in range(5)) for _ in range(70_000))
    want, began = plain(f"  {text}  "), time.time()
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(T.char_ngrams("text", strip_accents=False).alias("g"), T.char_ngrams("text", strip_accents=False, marked=True).alias("m")).first()
    assert time.time() - began < 30  # minutes, if each n-gram were looked for from the start of the text
    assert got["g"] == want
    assert got["m"] == [g for g in want if any(c in T.ACCENTED for c in g)]


def test_assertions(spark):
    cases = [
        ("Không sốt, có ho khan", "sốt", "isNegated"),
        ("Không sốt, có ho khan", "ho khan", ""),
        ("Mẹ bệnh nhân bị đái tháo đường", "đái tháo đường", "isFamily"),
        ("Tôi bị đau đầu nhiều năm nay", "đau đầu", ""),
        ("Tiền sử: viêm phổi\nKhám: sốt cao", "viêm phổi", "isHistorical"),
        ("Tiền sử: viêm phổi\nKhám: sốt cao", "sốt cao", ""),
        ("Bệnh nhân đã từng mổ ruột thừa", "mổ ruột thừa", "isHistorical"),
        ("Bà bị tăng huyết áp", "tăng huyết áp", ""),
        ("Đau đầu, sau đó mẹ cũng bị", "Đau đầu", ""),
    ]
    docs = spark.createDataFrame([(str(k), t) for k, (t, _, _) in enumerate(cases)], "doc_id string, text string")
    spans = spark.createDataFrame([(str(k), t.index(m), t.index(m) + len(m), m, "CHẨN_ĐOÁN") for k, (t, m, _) in enumerate(cases)], "doc_id string, start long, end long, text string, type string")
    got = {r["doc_id"]: ",".join(r["assertions"]) for r in assertions.assertions(spans, docs).collect()}
    assert got == {str(k): want for k, (_, _, want) in enumerate(cases)}


def test_alias_hits_take_the_longest(spark):
    docs = spark.createDataFrame([("a", "Khám: viêm phổi thùy dưới, ast và AST")], "doc_id string, text string")
    concepts = spark.createDataFrame([("1", "viêm phổi", ["viêm phổi thùy dưới"]), ("2", "AST", [])], "concept_id string, canonical_name string, aliases array<string>")
    concepts = concepts.withColumn("entity_type", F.lit("CHẨN_ĐOÁN")).withColumn("metadata", F.create_map(F.lit("name_quality"), F.lit("clean")))
    hits = lexicon.alias_hits(docs, lexicon.build_lexicon(concepts, max_share=1.0)).orderBy("start").collect()
    assert [h["text"] for h in hits] == ["viêm phổi thùy dưới", "AST"]


def test_places_in_a_long_text(spark):
    line = "Khám: viêm phổi 😀 thùy dưới, ast\tvà AST_1 (hết).\n"
    texts = {"a": line * 3_000, "b": "", "c": "AST", "d": " , "}
    docs = spark.createDataFrame([*texts.items(), (None, "AST")], "doc_id string, text string")
    spans = [(d, *m.span(), m.group()) for d, t in texts.items() for m in re.finditer(r"\w+", t)]
    began = time.time()
    got = document.words_at(docs.where("doc_id is not null"), lambda w: F.length(w) >= 4)
    assert sorted((r["doc_id"], r["start"], r["end"], r["text"]) for r in got.collect()) == sorted(s for s in spans if len(s[3]) >= 4)
    cut = document.with_slices(spark.createDataFrame([s[:3] for s in spans] + [("c", 1, 9), ("c", 9, 12), ("a", 500, 1600)], "doc_id string, start long, end long"), docs, text=("start", "end"))
    assert all(r["text"] == texts[r["doc_id"]][r["start"] : r["end"]] for r in cut.collect())
    concepts = spark.createDataFrame([("1", "AST", []), ("2", "dưới", ["dưới ast và"])], "concept_id string, canonical_name string, aliases array<string>")
    concepts = concepts.withColumn("entity_type", F.lit("CHẨN_ĐOÁN")).withColumn("metadata", F.create_map(F.lit("name_quality"), F.lit("clean")))
    hits = lexicon.alias_hits(docs, lexicon.build_lexicon(concepts, max_share=1.0))
    want = [("a", m.start(), m.end(), m.group()) for m in re.finditer("dưới, ast\tvà", texts["a"])] + [("c", 0, 3, "AST")]
    assert sorted((r["doc_id"], r["start"], r["end"], r["text"]) for r in hits.collect()) == sorted(want)
    assert time.time() - began < 60


def test_pooled_proposals_are_made_once(spark):
    docs = spark.createDataFrame([("a", "Khám: viêm phổi")], "doc_id string, text string")
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(1)
            yield b

    seeds = spark.createDataFrame([("a", 6, 15, "CHẨN_ĐOÁN"), ("a", 6, 99, "THUỐC")], "doc_id string, start long, end long, type string").coalesce(1)
    found = pipeline.collect(docs, seeds.mapInArrow(counted, seeds.schema), None, None)
    assert [(r["start"], r["end"], r["text"]) for r in found.collect()] == [(6, 15, "viêm phổi")]
    assert runs.value == 1  # three times, if the pool were met anew by each side of its joins


def test_resolve_overlaps_equals_a_loop(spark):
    rng, rows = random.Random(3), []
    for doc in range(40):
        seen = set()
        for _ in range(rng.randint(1, 12)):
            s = rng.randint(0, 30)
            span = (s, s + rng.randint(1, 10), rng.choice(proposals.TYPES))
            if span not in seen:
                seen.add(span)
                rows.append((doc, *span, rng.sample(["e3", "qwen_context", "governed_alias"], rng.randint(1, 3))))
    want = set()
    for doc in range(40):
        kept = []
        key = lambda r: (len(r[4]), "e3" in r[4], r[2] - r[1], -r[1])
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (-len(r[4]), r[1] - r[2], r[1], r[3])):
            foe = next((i for i, k in enumerate(kept) if k[1] < r[2] and r[1] < k[2]), None)
            if foe is None:
                kept.append(r)
                continue
            k = kept[foe]
            if not (k[1] <= r[1] and r[2] <= k[2]) and ((r[1] <= k[1] and k[2] <= r[2]) or key(r) > key(k)):
                kept[foe] = r
        want |= {k[:4] for k in kept}
    df = spark.createDataFrame(rows, "doc_id long, start long, end long, type string, sources array<string>")
    assert {tuple(r) for r in resolver.resolve_overlaps(df).select("doc_id", "start", "end", "type").collect()} == want


def test_bridges(spark):
    say = lambda g: one(spark, lattice.bridge_reason(F.lit(g)))
    assert say("") == "fragments_overlap_or_touch"
    assert say(" và ") == "bridge_contains_connector"
    assert say(" a b ") == "bridge_longer_than_one_token"
    assert say(", ") == "bridge_crosses_punctuation_or_newline"
    assert say(" Gan ") == "bridge_contains_unexpected_capitalised_word"
    assert say(" gan ") == "bridge_is_a_single_ordinary_word"


@pytest.mark.parametrize(
    ("reply", "want"),
    [('x {"a": "}"} y {', '{"a": "}"}'), ("<think>{}</think>```json\n{\"b\": 1}\n```", '{"b": 1}'), ('{"a": [', "truncated_before_json_closed"), ("no", "no_json_object_found"), ("<think>open", "empty_reply")],
)
def test_first_object(reply, want):
    body, why = models.first_object(reply)
    assert (body or why) == want


def test_verdicts_are_strict():
    failed, rows, counts = models._verdict_rows('{"verdicts": [{"index": 0, "action": "accept"}, {"index": -1, "action": "accept"}, {"index": 7, "action": "accept"}, {"index": "0", "action": "accept"}, {"index": true, "action": "accept"}, {"index": 1.5, "action": "accept"}, {"index": 1, "action": "keep"}]}', 2)
    assert not failed
    assert [r["index"] for r in rows] == [0]
    assert counts == {"invalid_index": 5, "invalid_action": 1}


def test_selection(spark):
    replies = {"A": "SELECT", " [B] ": "SELECT", "NONE": "NONE", "Z": "invalid_option", "A and B": "multiple_options", "": "parse_failed", "1191": "returned_a_code", "J18.9": "returned_a_code"}
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "mention_id long, reply string")
    options = spark.createDataFrame([(k, x, x.lower()) for k in range(len(replies)) for x in "AB"], "mention_id long, letter string, concept_id string")
    got = {r["reply"]: r["reason"] or r["decision"] for r in linking.parse_selection(rows, options).collect()}
    assert got == replies


def test_fileset(spark):
    have, want = (spark.createDataFrame([(x,) for x in s], "name string") for s in (("1.json", "x"), ("1.json", "2.json")))
    assert {tuple(r) for r in validation.fileset_diff(have, want).collect()} == {("2.json", "missing_file"), ("x", "unexpected_file")}
