"""Readers, sinks, streaming, registry, facts, the strict check and side files."""

import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.__main__ import main
from spanforge.functions import text as T
from spanforge.functions import unicode
from spanforge.operators import document, facts, kb, linking, models, proposals, resolver, retrievers, strict
from spanforge.sources import provenance, readers, sinks
from spanforge.streaming.extract import extract_stream

DIAGNOSIS, DRUG = "CHẨN_ĐOÁN", "THUỐC"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def notes_dir(tmp_path):
    (tmp_path / "notes").mkdir()
    for k, t in ((1, "Khám: bệnh nhân viêm phổi.\nXử trí: aspirin 500mg."), (2, "Bệnh nhân không sốt"), (3, "")):
        (tmp_path / "notes" / f"{k}.txt").write_text(t)
    (tmp_path / "seeds").mkdir()
    (tmp_path / "seeds" / "1.json").write_text(json.dumps([{"text": "viêm phổi", "type": DIAGNOSIS, "position": [16, 25], "assertions": [], "candidates": []}]))
    (tmp_path / "seeds" / "2.json").write_text('{"no": "list"}')
    return tmp_path


def test_readers(spark, notes_dir, tmp_path):
    notes = readers.notes(spark, str(notes_dir / "notes"))
    assert {r["doc_id"] for r in notes.collect()} >= {"1", "2"}
    assert rows(readers.seeds(spark, str(notes_dir / "seeds")).select("doc_id", "start", "end", "text")) == [("1", 16, 25, "viêm phổi")]
    index = {"records": [{"concept_id": "J189", "canonical_name": "a"}, {"concept_id": "", "canonical_name": "b"}, {"concept_id": "J189", "canonical_name": "c"}], "exact": {"viêm phổi": ["J189"]}, "graph": {"J18": ["J189"]}}
    (tmp_path / "index.json").write_text(json.dumps(index))
    concepts, postings, edges = readers.inverted_index(spark, str(tmp_path / "index.json"), "ICD10")
    assert rows(concepts.select("concept_id", "canonical_name")) == [("J189", "c")]
    assert rows(postings) == [("ICD10", "exact", "viêm phổi", "J189")] and rows(edges) == [("ICD10", "J18", "J189")]
    (tmp_path / "drugs.jsonl").write_text('{"rxcui": "1", "name": "x"}\n{"name": "none"}\n{"rxcui": "1", "name": "x"}\n')
    assert rows(readers.drugs(spark, str(tmp_path / "drugs.jsonl")).select("rxcui", "name")) == [("1", "x")]
    (tmp_path / "rel.rrf").write_text("1|has|2|tradename_of|S|R|N\n")
    assert readers.rrf(spark, str(tmp_path / "rel.rrf"), "rxnrel").first()["rela"] == "tradename_of"
    assert rows(readers.revision_conflicts(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "key string, revision string"))) == [("a", 2)]
    assert len(readers.digests(spark, str(tmp_path / "rel.rrf")).first()["sha256"]) == 64
    assert readers.documents_json(spark, str(tmp_path / "index.json")).first()["name"] == "index.json"


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("1", "sốt ho"), ("2", "x")], "doc_id string, text string")
    found = spark.createDataFrame([("1", 0, 3, "sốt", "TRIỆU_CHỨNG", ["isNegated"])], "doc_id string, start long, end long, text string, type string, assertions array<string>")
    payloads = sinks.organizer_documents(found, docs)
    folder = sinks.export_folder(payloads, tmp_path / "output")
    assert json.loads((folder / "1.json").read_text()) == [{"text": "sốt", "type": "TRIỆU_CHỨNG", "assertions": ["isNegated"], "position": [0, 3]}]
    assert json.loads((folder / "2.json").read_text()) == []
    a, b = (sinks.archive(folder, tmp_path / f"{k}.zip", 2).read_bytes() for k in "ab")
    assert a == b and sinks.unsafe_entries(tmp_path / "a.zip") == []
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        for n in ("../x.json", "output/a/b.json", "/etc/x"):
            z.writestr(n, "[]")
    assert len(sinks.unsafe_entries(tmp_path / "bad.zip")) == 3
    with pytest.raises(ValueError, match="expected"):
        sinks.archive(folder, tmp_path / "c.zip", 3)
    (folder / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="other files"):
        sinks.safe_output(folder)
    sinks.write_variants(found.withColumn("variant", F.lit("high")), str(tmp_path / "variants"))
    assert (tmp_path / "variants" / "variant=high").is_dir()
    assert sinks.same_style("[]", [{"a": 1}]) == '[{"a":1}]\n' and sinks.same_style("[\n  {}]", [1]) == "[\n  1\n]\n"


def test_command_line(spark, notes_dir, tmp_path):
    (notes_dir / "notes" / "3.txt").write_text("x")
    assert main(["extract", "--notes", str(notes_dir / "notes"), "--seeds", str(notes_dir / "seeds"), "--out", str(tmp_path / "found")]) == 0
    assert rows(spark.read.parquet(str(tmp_path / "found")).select("doc_id", "text", "type")) == [("1", "viêm phổi", DIAGNOSIS)]
    main(["pack", "--notes", str(notes_dir / "notes"), "--entities", str(tmp_path / "found"), "--folder", str(tmp_path / "output"), "--archive", str(tmp_path / "o.zip"), "--expected", "3"])
    assert main(["check", "--archive", str(tmp_path / "o.zip")]) == 0


def test_streaming(spark, notes_dir, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("doc_id string, text string").json(str(tmp_path / "in"))
    (tmp_path / "in" / "a.json").write_text('{"doc_id": "1", "text": "Khám: viêm phổi nặng"}\n')
    concepts = spark.createDataFrame([("J189", "viêm phổi", [])], "concept_id string, canonical_name string, aliases array<string>").withColumn("entity_type", F.lit(DIAGNOSIS)).withColumn("metadata", F.create_map(F.lit("name_quality"), F.lit("clean")))
    from spanforge.operators import lexicon

    given = spark.createDataFrame([("1", 6, 15, DIAGNOSIS)], "doc_id string, start long, end long, type string")
    query = extract_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), lexicon.build_lexicon(concepts, max_share=1.0), given)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("text", "sources").collect()
    assert [(r["text"], sorted(r["sources"])) for r in got] == [("viêm phổi", ["e3", "governed_alias"])]


def test_roles_gate_retrievers(spark):
    both, only = retrievers.Retriever("general", ("diagnosis", "drug")), retrievers.Retriever("clinical", ("diagnosis",))
    off = retrievers.Retriever("off", ("drug",), enabled=False)
    assert [s.key for s in retrievers.retrievers_for([both, only, off], "drug")] == ["general"]
    with pytest.raises(ValueError, match="not declared"):
        retrievers.assert_role(only, "RXNORM")
    with pytest.raises(KeyError):
        retrievers.encoder_of(both, {})
    with pytest.raises(ValueError, match="pools by"):
        retrievers.encoder_of(both, {"general": ("cls", None)})
    factory = models.hashed_trigrams
    factories = {k: ("mean", lambda: factory(32)) for k in ("general", "clinical")}
    concepts = spark.createDataFrame([("ICD10", "J189", "viêm phổi"), ("ICD10", "I10", "tăng huyết áp"), ("RXNORM", "1191", "aspirin")], "ontology string, concept_id string, text string")
    index = models.encode(concepts, lambda: factory(32)).select("ontology", "concept_id", "vec")
    asked = spark.createDataFrame([("m1", "ICD10", "raw", "viêm phổi"), ("m2", "RXNORM", "raw", "aspirin"), ("m3", "RXNORM", "other", "aspirin")], "mention_id string, ontology string, view string, text string")
    got = rows(retrievers.dense_hits(asked, {"general": index, "clinical": index}, [both, only, off], factories, top=1))
    assert got == sorted([("m1", "J189", "general", "raw", 1), ("m1", "J189", "clinical", "raw", 1), ("m2", "1191", "general", "raw", 1)], key=repr)


def test_pooling():
    states, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert (retrievers.pool(states, mask, "cls") == states[:, 0]).all()
    assert (retrievers.pool(states, mask, "mean") == states[:, :2].mean(1)).all()


@pytest.fixture
def kb_tables(spark):
    concepts = spark.createDataFrame([("RXNORM", "1191", "aspirin", [], {"tty": "IN"}), ("RXNORM", "2001", "aspirin 500 MG Oral Tablet", [], {"tty": "SCD"}), ("ICD10", "J189", "Viêm phổi", ["viêm phổi không xác định"], None), ("ICD10", "J18", "Viêm phổi chung", [], None), ("ICD10", "J180", "Viêm phế quản phổi", [], None)], "ontology string, concept_id string, canonical_name string, aliases array<string>, metadata map<string,string>")
    drugs = spark.createDataFrame([("2001", ["aspirin"], [("500", "mg", "500 MG")], ["Oral Tablet"], None, None)], "rxcui string, ingredients array<string>, strengths array<struct<value:string,unit:string,raw:string>>, dose_forms array<string>, rxterm_form string, available_strength string")
    return concepts, drugs


def test_facts(spark, kb_tables):
    concepts, drugs = kb_tables
    asked = spark.createDataFrame([("aspirin 100mg", "RXNORM", "2001"), ("ibuprofen viên", "RXNORM", "2001"), ("aspirin", "RXNORM", "1191"), ("aspirin", "RXNORM", "none"), ("viêm phổi", "ICD10", "J189")], "mention string, ontology string, concept_id string")
    got = {(r["mention"], r["concept_id"]): r["lines"] for r in facts.candidate_lines(asked, concepts, drugs).collect()}
    base = ["RxCUI 2001: aspirin 500 MG Oral Tablet", "  TTY SCD; ingredient aspirin; strength 500 MG; form Oral Tablet"]
    assert got == {
        ("aspirin 100mg", "2001"): [*base, "  CONFLICTS WITH THE MENTION: strength_conflict"],
        ("ibuprofen viên", "2001"): [*base, "  CONFLICTS WITH THE MENTION: dose_form_conflict, ingredient_conflict"],
        ("aspirin", "1191"): ["RxCUI 1191: aspirin", "  TTY IN"],
        ("viêm phổi", "J189"): ["code J189: Viêm phổi", "  also called: viêm phổi không xác định", "  category: J18 Viêm phổi chung", "  competing sibling codes in this category: 1"],
    }
    assert facts.drug_text(drugs).first()["text"] == "RxCUI 2001 | ingredient: aspirin | strength: 500 MG | dose form: Oral Tablet"
    assert kb.drug_conflicts(spark.createDataFrame([("x", False)], "mention string, known boolean").selectExpr("mention", "cast(null as array<string>) ingredients", "cast(null as array<struct<value:string,unit:string,raw:string>>) strengths", "cast(null as array<string>) dose_forms", "cast(null as string) rxterm_form", "known")).first()["conflicts"] == []


def test_strict_check(spark):
    docs = spark.createDataFrame([("a", "sốt cao, sốt nhẹ, aspirin")], "doc_id string, text string")
    said = [(0, " sốt ", "TRIỆU_CHỨNG", ["isNegated", "other"], ["X"], ["X"]), (1, "sốt", "TRIỆU_CHỨNG", [], [], []), (2, "sốt", "TRIỆU_CHỨNG", None, None, None), (3, "", "TRIỆU_CHỨNG", [], [], []), (4, "ho", "TRIỆU_CHỨNG", [], [], []), (5, "aspirin", DRUG, ["isHistorical"], ["1191", "1191", "9"], ["1191"]), (6, "cao", "?", [], [], [])]
    table = spark.createDataFrame([("a", *x) for x in said], "doc_id string, idx int, text string, type string, assertions array<string>, candidates array<string>, offered array<string>")
    kept, rejected = strict.strictly(table, docs)
    assert rows(kept) == sorted([("a", "sốt", "TRIỆU_CHỨNG", 0, 3, ["isNegated"], []), ("a", "sốt", "TRIỆU_CHỨNG", 9, 12, [], []), ("a", "aspirin", DRUG, 18, 25, ["isHistorical"], ["1191"])], key=repr)
    assert {(r["reason"], r["n"]) for r in rejected.collect()} == {("occurrence_exhausted", 1), ("empty_text", 1), ("span_not_found", 1), ("ungoverned_candidate", 1), ("unknown_type", 1)}


def test_provenance(spark, tmp_path):
    path, record = str(tmp_path / "p.json"), {f: 1 for f in provenance.FIELDS}
    assert provenance.read_provenance(spark, path) is None and provenance.model_manifest(spark, path) == []
    provenance.write_provenance(spark, path, record | {"rows": 2})
    provenance.write_provenance(spark, path, record)
    assert provenance.read_provenance(spark, path) == record
    provenance.assert_compatible(record, dict(record))
    with pytest.raises(ValueError, match="rows, |settings"):
        provenance.assert_compatible(record, record | {"settings": 2, "rows": 3})
    provenance.write_provenance(spark, str(tmp_path / "m.json"), {"models": [{"key": "a"}]})
    assert provenance.model_manifest(spark, str(tmp_path / "m.json")) == [{"key": "a"}]
    header = json.dumps({"__metadata__": {}, "a": {"shape": [3, 4]}, "b": {"shape": []}}).encode()
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + b"\0" * 52)
    assert provenance.tensor_parameters(spark, str(tmp_path)) == 13


def test_dense_index_is_checked(spark, tmp_path, kb_tables):
    factory = models.hashed_trigrams
    documents = kb.kb_documents(kb_tables[0].where("ontology = 'ICD10'"))
    with pytest.raises(ValueError, match="pinned"):
        models.dense_index(documents, lambda: factory(16), str(tmp_path / "i"), "r", "main", 16)
    models.dense_index(documents, lambda: factory(16), str(tmp_path / "i"), "r", "a" * 40, 16)
    vectors, manifest = spark.read.parquet(str(tmp_path / "i/vectors")), spark.read.json(str(tmp_path / "i/manifest"))
    assert models.index_problems(vectors, manifest, "r", "a" * 40, 16) == []
    assert models.index_problems(vectors.limit(1), manifest, "r", "b" * 40, 8) == ["revision", "dim", "rows"]


def test_prompts_and_variants(spark):
    docs = spark.createDataFrame([("a", "Khám: sốt cao\n\nho")], "doc_id string, text string")
    prompts = models.pass_prompts(docs).collect()
    assert len(prompts) == 3 and all("L001| Khám: sốt cao\nL003| ho" in p["prompt"] for p in prompts)
    opts = spark.createDataFrame([("a", 0, 0, 6, 9, "TRIỆU_CHỨNG", "sốt"), ("a", 0, 1, 6, 13, "TRIỆU_CHỨNG", "sốt cao")], "doc_id string, group_id long, option_idx long, start long, end long, type string, text string")
    prompt = models.verification_prompts(opts, docs).first()
    assert '[0] TRIỆU_CHỨNG: "sốt"\n[1] TRIỆU_CHỨNG: "sốt cao"' in prompt["prompt"] and prompt["n_options"] == 2
    ents = spark.createDataFrame([(1, ["e3"], False), (2, ["qwen_context"], False), (3, ["e3", "qwen_context"], False)], "id int, sources array<string>, subsumes_seed boolean")
    assert {n: [r[0] for r in rows(resolver.variant(ents, n).select("id"))] for n in ("control", "broad")} == {"control": [1, 3], "broad": [1, 2, 3]}
    pick = lambda v, c, r: spark.range(1).select(linking.candidates_for(v, F.lit(c), F.lit(r))).first()[0]
    assert pick("allnull", "x", "exact") == [] and pick("broad", "x", "single_source_only") == ["x"] and pick("high", "x", "single_source_only") == [] and pick("high", "x", "exact") == ["x"]


def test_unicode_and_pins(spark):
    df = spark.createDataFrame([("é",), ("abc",), (None,)], "t string")
    assert {r[0] for r in unicode.normalized(df, "t").collect()} == {"é", "abc", None}
    assert spark.range(1).select(T.is_pinned(F.lit("a" * 40)), T.is_pinned(F.lit("main"))).first()[:] == (True, False)


def test_as_of_takes_the_last_row_at_or_before(spark):
    spans = spark.createDataFrame([("a", 0), ("a", 5), ("a", 9), ("b", 1), (None, 5)], "doc_id string, start long")
    marks = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y"), (None, 1, "z")], "doc_id string, start long, mark string")
    assert rows(document.as_of(spans, marks, prefix="m_").select("doc_id", "start", "m_mark")) == sorted([("a", 0, None), ("a", 5, "x"), ("a", 9, "y"), ("b", 1, None), (None, 5, None)], key=repr)
    assert proposals.TYPES
