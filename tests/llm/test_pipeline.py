"""The corpus pipeline, stage by stage against brute force on a small table with odd rows."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanforge.llm import decontamination, language, mixing

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """sf0.001 with null, empty and letterless texts, repeated rows, one doc_id of two texts, and planted copies."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{D}/documents.parquet")
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    long = docs.orderBy(F.length("text").desc()).first()
    near = long["text"].split()
    near[len(near) // 2] = "changed"
    odd = [(10_001, None), (10_002, ""), (10_003, "123 ²"), (10_004, " ".join(near)), (10_004, " ".join(near)), (10_005, f"some words before {item} and after"), (None, "a text without an id"), (long["doc_id"], "another text of the same id, short and plain")]
    rows = spark.createDataFrame([(d, t, "en", "odd", len(t or "")) for d, t in odd], docs.schema)
    docs.union(rows).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output rows of each stage, written and read again between them."""
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()], after.columns)
        docs = after
    assert all(columns == names for _, _, columns in list(out.values())[:-1])
    return out


def rows_of(rows):
    return sorted(rows, key=repr)


def test_language_stage(spark, sf_dir, stages):
    before, after, _ = stages["language_id"]
    gone = [r for r in before if r not in after]
    assert {r[0] for r in gone} >= {10_001, 10_002, 10_003}
    assert len(gone) <= 3 + len(before) // 100  # clean documents stay
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, net = language.fit(spark, docs)
    least = P.OVER_EVEN / len(langs)
    want = [r for r in before if language.has_letter(r[1]) and language.pooled(net, [r[1].encode()], len(langs)).max() >= least]
    assert rows_of(after) == rows_of(want)


def test_near_duplicate_stage(stages):
    before, after, _ = stages["ngram_jaccard_join"]
    words = lambda t: t.encode().lower().split()
    said = {}
    for r in before:
        said.setdefault(r[0], []).append(r)
    single = {d: rs[0] for d, rs in said.items() if d is not None and len({r[1] for r in rs}) == 1}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, r in single.items() for w in [words(r[1])]}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            n = len(sets[x] & sets[y])
            if n and 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    torn = {d for d, rs in said.items() if d is not None and len({r[1] for r in rs}) > 1}
    got = {r[0] for r in after if r[0] in sets}
    # what links to the document of two texts depends on the text that speaks for it
    near_torn = {d for d in sets if any(len(s & sets[d]) * 100 >= 80 * len(s | sets[d]) for t in torn for r in said[t] for w in [words(r[1])] for s in [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}])}
    assert {d for d in got if d not in near_torn} == {d for d in sets if root(d) == d and d not in near_torn}
    assert sum(r[0] is None for r in after) == 1 and len([r for r in after if r[0] == 10_004]) <= 1
    assert all(len([r for r in after if r[0] == d]) == 2 for d in torn)


def test_decontamination_stage(spark, sf_dir, stages):
    before, after, _ = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    matcher = decontamination.Matcher(items)
    assert rows_of(after) == rows_of([r for r in before if not matcher.matches(r[1])])
    assert 10_005 not in {r[0] for r in after}


def test_mixing_stage(spark, sf_dir, stages):
    before, after, _ = stages["target_mixing"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    kept = {r[0] for r in after}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1} & {r[0] for r in before}
    clean = {r["doc_id"] for r in labels if r["toxic"] == 0} & {r[0] for r in before}
    assert len(toxic - kept) >= 0.9 * len(toxic) and len(clean & kept) >= 0.98 * len(clean)
    assert set(after) <= set(before)
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    again = [{r["doc_id"]: r["r"] for r in mixing.with_posteriors(spark, part, mixing.fit_classifier(spark, part, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", F.col("p_toxic").alias("r")).collect()} for part in (docs, docs.coalesce(1))]
    assert again[0] == again[1]  # the same in any layout


def test_token_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after, columns = stages["token_output"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = [columns.index(c) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    encoded = {r: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in before}
    want = sorted((r[0] if r[0] is not None else -1, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for r, ids in encoded.items())
    got = sorted(((r[at[0]] if r[at[0]] is not None else -1), r[at[2]], r[at[3]]) for r in after)
    assert got == want
    places = sorted((r[at[1]], r[at[2]]) for r in after)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0


def test_run_equals_its_stages(spark, sf_dir, stages):
    _, after, columns = stages["token_output"]
    got = P.run(spark, sf_dir)
    assert got.columns == columns and rows_of(tuple(r) for r in got.collect()) == rows_of(after)


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
