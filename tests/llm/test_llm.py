"""The ten operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import decontamination, fingerprint, language, mixing, ngram_join, pii, sharding, substring_dedup, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, rep string"
WORDS = [f"w{k}" for k in range(60)]


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def corpus(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 40, 90, 200]))) for _ in range(30)]
    near = []
    for t in base[:12]:
        for _ in range(9):
            w = t.split()
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(50))
            near.append(" ".join(w))
    passage = " ".join(f"p{k}" for k in range(70))
    texts = [None, "", "  \n", "é ß Ä", *base, *base[:5], *near, *[f"{rng.choice(base)} {passage} tail{k}" for k in range(12)], " ".join(rng.choice(WORDS) for _ in range(4000))]
    rng.shuffle(texts)
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s", None]), None, None, None) for k, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id here", "en", "s", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(spark, docs, empty):
    rows = [(d, t) for d, t, *_ in corpus() if d is not None]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for d, t in rows for w in [words_of((t or "").lower())]}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in sets:
        for y in sets:
            i = len(sets[x] & sets[y])
            if x < y and i and 100 * i >= 80 * (len(sets[x]) + len(sets[y]) - i):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    out = ngram_join.near_duplicates(spark, docs).collect()
    assert len(out) == docs.count()
    assert {(r[0], r[1], r[2]) for r in out if r[0] is not None} == {(d, len(s), root(d)) for d, s in sets.items()}
    assert ngram_join.near_duplicates(spark, empty).count() == 0


@pytest.mark.parametrize(("times", "parts"), [(2, 1), (7, 1), (8, 1), (9, 3), (20, 1), (20, 4)])
def test_ngram_join_of_one_document_often(spark, times, parts):
    rng = random.Random(times)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(1, " ".join(base))] * times + [(2, " ".join([*base[:90], "new", *base[91:]]))]
    out = ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert len(out) == times + 1 and {r["component_id"] for r in out} == {1}


def test_ngram_join_of_torn_documents(spark):
    """Rows of one doc_id with different texts: one of the texts speaks for all, in every order of the rows."""
    base = " ".join(f"b{k}" for k in range(50))
    other = " ".join(f"c{k}" for k in range(40))
    rows = [(1, base), (5, base), (5, other), (5, None), (7, other), (None, base)]
    speaks = spark.createDataFrame([(base,), (other,)], "t string").orderBy(F.xxhash64("t")).first()[0]
    want = [(1, 46, 1), (5, 46, 1 if speaks == base else 5), (5, 36, 1 if speaks == base else 5), (5, 0, 1 if speaks == base else 5), (7, 36, 7 if speaks == base else 5), (None, 46, None)]
    for order in (rows, rows[::-1]):
        out = ngram_join.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n_copies", [5, 6, 7, 8, 9])
def test_ngram_join_of_repeated_rows(spark, n_copies):
    rng = random.Random(n_copies)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for d in range(n_copies):
        w = list(base)
        w[10 + 20 * d] = f"new{d}"
        rows += [(5 + d, " ".join(w))] * 2
    out = ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(d, 5) for d, _ in rows]


def test_token_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 9, 70000):
        for kind in (1, 8):
            ids = rng.integers(0, 1 << 20, n).astype("<u4")
            assert (tokens.unpack_block(tokens.pack_block(ids, kind)) == ids).all()
    assert tokens.join_crc(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_tokens(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    odd = ["Don't x", "a<|endoftext|>b", "été ΟΔΟΣ İ", "x1 22", "tab\tnl\n\x0b nbsp y", "é"]
    for t in odd:
        assert list(np.frombuffer(fast.encode(t), "<u4")) == plain.encode(t, add_special_tokens=False).ids
    keyed = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    tokens.write_tokens(spark, keyed, str(tmp_path), path, block_ids=500)  # documents that span blocks
    got = {r[0]: (r[1], r[2], r[3]) for r in tokens.read_documents(spark, str(tmp_path)).collect()}
    at, want = 0, {}
    for r in sorted(keyed.collect(), key=lambda r: r["doc_id"]):
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert got == want
    tokens.write_tokens(spark, empty, str(tmp_path / "none"), path)
    assert tokens.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_substring_dedup(spark, docs, empty, monkeypatch):
    first, want = {}, {}
    for d, t in sorted({(d, t) for d, t, *_ in corpus() if d is not None}):
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = [True] * 50
        want[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    monkeypatch.setattr(substring_dedup, "table", lambda *_: docs)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.op4_seed_extend_dedup(spark, "").collect() if r[0] is not None}
    assert got == want
    monkeypatch.setattr(substring_dedup, "table", lambda *_: empty)
    assert substring_dedup.op4_seed_extend_dedup(spark, "").count() == 0


def test_edit_matching(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch from the hill and count"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "short one"), (None, item), (1, item)], "item_id long, text string")
    rows = [(1, f"before {item.upper()} after"), (2, "so " + item.replace("brown", "brwn").replace("wizards", "wizzards")), (3, "the quick brown fox jumps over a cat"), (4, None), (5, ""), (None, "a short  one"), (6, "a short one2"), (None, "a short  one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__0": F.lit(1), "matches": F.lit(2), "start": F.lit(3)})
    got = sorted(map(tuple, decontamination.matches_of(spark, docs, bench).collect()), key=repr)
    want = [(1, i, 0, 5, 7, 7 + len(item)) for i in (1, 1, None)] + [(2, i, 2, 5, 3, 3 + len(item)) for i in (1, 1, None)] + [(None, None, 0, 0, 2, 11)] * 2
    assert got == sorted(want, key=repr)
    left = decontamination.without_matches(spark, docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontamination.matches_of(spark, docs.limit(0), bench).count() == 0
    assert decontamination.matches_of(spark, docs, bench.limit(0)).count() == 0


def test_edit_matching_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 40)
    bench = spark.createDataFrame([(k, f"item number {k} of a benchmark table") for k in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x item number {k} of a benchmark table y") for k in range(9)] + [(50, "clean")], "doc_id long, text string")
    assert sorted((r[0], r[1]) for r in decontamination.matches_of(spark, docs, bench).collect() if r[2] == 0) == [(k, k) for k in range(9)]
    assert [r[0] for r in decontamination.without_matches(spark, docs, bench).collect()] == [50]


def test_edit_distances_are_right():
    """Every item within its budget is found, with its least distance and a true place, in texts of random edits."""
    rng = random.Random(12)
    items = [(k, "".join(rng.choice("abcde ") for _ in range(rng.choice([30, 60, 120]))).strip()) for k in range(8)]
    matcher = decontamination.Matcher(items)

    def least(a, b, free):
        row = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row) if free else row[-1]

    for _ in range(60):
        k, item = rng.choice(items)
        t = list(decontamination.plain(item))
        for _ in range(rng.randrange(0, 9)):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], [rng.choice("abcdef")], [t[p], rng.choice("abcdef")]])
        text = decontamination.plain("".join(rng.choice("abcde ") for _ in range(50)) + "".join(t) + "".join(rng.choice("abcde ") for _ in range(50)))
        found = {m[0]: m for m in matcher.matches(text)}
        for i, raw in items:
            pattern = decontamination.plain(raw)
            budget, distance = int(0.06 * len(pattern)), least(pattern, text, True)
            assert (i in found) == (distance <= budget)
            if i in found:
                assert found[i][1] == distance == least(pattern, text[found[i][3] : found[i][4]], False)


def test_pii(spark, docs, empty):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab@..-_+ 12345() \n") for _ in range(60)) for _ in range(150)] + ["4111 1111-1111 1111", "😀 a@b.c_x@d.e", "1.2.3.4.5.6.7.8 300.1.1.1", "1" * 20000, "a" * 20000, None, ""]

    def keeps(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    rows, _ = pii.extract(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in rows.collect():
        t = texts[r["doc_id"]] or ""
        for kind, regex in plain.items():
            assert [(x["start"], x["end"]) for x in r[kind]] == [m.span() for m in re.finditer(regex, t) if keeps(kind, m.group())]


def test_pii_finds_unseen(spark):
    """Unseen identifiers in sure contexts are found, whole phones are seeds, and what only looks or only stands alike is left."""
    rows = [(k, f"text {k % 7} contact +1 (200) 555-{1000 + k} now") for k in range(60)] + [(60 + k, f"some contact +1(20{k})5x5-770 now") for k in range(3)]
    rows += [(k, f"mail user{k}@site.org today") for k in range(100, 140)] + [(200, "mail user7@localhost today"), (201, "mail 7 today"), (202, "room user8@localhost here")]
    rows += [(300 + k, f"costs {k} euros") for k in range(60)] + [(400, "costs +1(207)5x5-771 euros")]
    _, extra = pii.extract(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["kind"], r["text"]) for r in extra.collect()}
    assert got == {("email", "user7@localhost"), *(("phone", f"+1(20{k})5x5-770") for k in range(3))}


def test_pii_of_odd_rows(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(pii, "table", lambda *_: empty)
    assert pii.op8_contextual_pii(spark, "").count() == 0
    odd = spark.createDataFrame([(1, None), (1, None), (None, "a@b.cd"), (2, ""), (3, "x 1.2.3.4 " * 3)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "email", "words", "kind", "score")})
    monkeypatch.setattr(pii, "table", lambda *_: odd)
    got = sorted(pii.op8_contextual_pii(spark, "").collect(), key=repr)
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in got) == [(0, 1, 0, "email:0:6"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 3, "ip:2:9,ip:12:19,ip:22:29")]


def test_pii_of_a_very_long_text(spark):
    n = 100_000
    text = " ".join(str(1000 + k) for k in range(n))
    docs = spark.createDataFrame([(1, text + " 1.2.3.4"), (2, "1" * 3_000_000), (3, "a@" * 500_000)], "doc_id long, text string")
    rows, _ = pii.extract(spark, docs)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert [(x["start"], x["end"]) for x in got[1]["ip"]] == [(len(text) + 1, len(text) + 8)]
    assert not got[2]["card"] and not got[3]["email"]


def test_hilbert(spark, docs, empty):
    grid = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    h = sharding.hilbert_index(list(grid.T), 2)
    assert sorted(h) == list(range(64))
    assert abs(np.diff(grid[np.argsort(h)], axis=0)).sum(1).max() == 1


def _shards(spark, docs, path):
    shard, slot = sharding.write_shards(spark, docs, path)
    return shard, slot, spark.read.parquet(path)


def test_shards_hold_every_row_once(spark, docs, tmp_path):
    clash = docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("k", F.lit(3))
    many = clash.union(clash.where("doc_id is null or doc_id % 3 = 0")).union(clash.limit(1)).repartition(3)
    shard, slot, files = _shards(spark, many, str(tmp_path / "x"))
    assert {shard, slot}.isdisjoint(many.columns)
    key = lambda r: tuple(map(repr, (r[c] for c in sorted(many.columns))))
    rows = files.collect()
    assert sorted(map(key, rows)) == sorted(map(key, many.collect()))
    sizes = [sum(r[shard] == k for r in rows) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r[slot] for r in rows if r[shard] == k) == list(range(n)) for k, n in enumerate(sizes))
    # brute force: the curve's order over all rows, cut into equal runs
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    crc = lambda v: spark.range(1).select(F.pmod(F.xxhash64(F.lit(v).cast("string")), F.lit(1024))).first()[0]
    code = {(c, v): crc(v) for c in ("source", "lang") for v in {r[c] for r in rows}}
    least, span = min(ids), max(ids) - min(ids) + 1

    def curve(r):
        size = len((r["text"] or "").encode()) + 1
        dims = [int((r["doc_id"] - least) * 1023 / span) if r["doc_id"] is not None else 0, min(1023, int(np.log2(size) * 1024 / 40)), code["source", r["source"]], code["lang", r["lang"]]]
        return int(sharding.hilbert_index([np.array([d]) for d in dims])[0]), r["doc_id"] is not None, r["doc_id"] or 0, size, zlib.crc32((r["text"] or "").encode())

    in_order = [curve(r) for r in sorted(rows, key=lambda r: (r[shard], r[slot]))]
    assert in_order == sorted(in_order)


def test_shards_of_few_rows(spark, docs, empty, tmp_path):
    for n in (1, 3):
        shard, slot, files = _shards(spark, docs.limit(n), str(tmp_path / str(n)))
        assert sorted((r[shard], r[slot]) for r in files.collect()) == [(k, 0) for k in range(n)]
    assert sharding.write_shards(spark, empty, str(tmp_path / "none")) == ("shard", "slot")


def test_shards_prune(spark, tmp_path):
    """A box query over language and size reads fewer files than if files followed doc_id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sharding.write_shards(spark, docs, str(tmp_path / "curve"))
    docs.repartitionByRange(32, "doc_id").write.parquet(str(tmp_path / "ids"))
    found = {}
    for name in ("curve", "ids"):
        found[name] = sharding.read_files(sharding.boxes(spark.read.parquet(str(tmp_path / name))), lang=("es", "es"), size=(0, 300))
    share = {k: some / n for k, (some, n) in found.items()}
    assert share["curve"] < 0.8 * share["ids"], found


def test_digest(spark, docs, empty):
    rows = sorted({(d, t or "") for d, t, *_ in corpus() if d is not None})
    keyed = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark, keyed).collect()}
    for k, (d, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follow[:cut]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["near_edited"] == float(fingerprint.canonical(edited) == fingerprint.canonical(t))
        assert got[d]["near_next"] == float(fingerprint.canonical(follow) == fingerprint.canonical(t))
    assert fingerprint.canonical("  ＡB\tc ") == "ab c"
    assert fingerprint.fingerprints(spark, empty).count() == 0


def test_urls(spark):
    bad, good = ["spam-win", "casino-x", "cheap-pill"], ["library", "school", "museum"]
    rows = [(k, f"http://{good[k % 3]}{k}.org/a/{k}") for k in range(300)] + [(1000 + k, f"http://{bad[k % 3]}{k}.com/de/{k}?win") for k in range(300)] + [(5000, "http://casino-x7.net/q"), (5001, "http://museum7.net/a/1"), (5002, None), (5003, "nothing"), (5004, "HTTP://A.Example.ORG/es/x#y")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000]["verdict"] == "block" and got[5001]["verdict"] == "allow"
    assert got[5002]["host"] == got[5003]["path"] == ""
    assert (got[5004]["host"], got[5004]["path"], got[5004]["rule"], got[5004]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")


def test_url_models_are_exact(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(20))
    rows = [(k, rng.choice(["http://a.org/{}", "http://b.com/de/{}", "http://c.net/{}"]).format(word())) for k in range(4000)] + [(4000, ""), (4001, None)]
    rules = (("allow", "org", "/"), ("block", "com", "/de/"))
    got = {r["page_id"]: r["score"] for r in urls.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string").repartition(3), rules).collect()}
    counts, total = [{}, {}], [0, 0]
    for k, u in rows:
        side = 0 if "a.org" in (u or "") else 1 if "b.com" in (u or "") else None
        if side is not None and zlib.crc32(str(k).encode()) % 5:
            b = u.encode()
            total[side] += len(b)
            for i in range(len(b)):
                for n in range(1, min(6, i + 1) + 1):
                    g = b[i + 1 - n : i + 1]
                    counts[side][g] = counts[side].get(g, 0) + 1
    assert len(set(counts[0]) | set(counts[1])) > 1 << 17  # more grams than any fixed table had
    for k, u in rows:
        b, want = (u or "").encode(), 0.0
        for i in range(len(b)):
            for side, sign in ((0, 1), (1, -1)):
                p = 1 / 256
                for n in range(1, min(6, i + 1) + 1):
                    c = counts[side].get(b[i + 1 - n : i + 1], 0)
                    context = counts[side].get(b[i + 1 - n : i], 0) if n > 1 else total[side]
                    p = (c + 4 * p) / (max(context, c) + 4)
                want += sign * np.log(p)
        assert abs(got[k] - want / max(len(b), 1)) < 1e-9


def test_gradients_are_right():
    net = language.BiGru(3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = np.frombuffer(b"abcdefgh", np.uint8).reshape(2, 4).T.astype(np.intp), np.array([0, 2])
    _, grads = net.gradients(x, y)
    for name in ("rec_f", "rec_b", "out"):
        w, eps = net.w[name], 1e-3
        w[1, 2] += eps
        up, _ = net.gradients(x, y)
        w[1, 2] -= 2 * eps
        down, _ = net.gradients(x, y)
        w[1, 2] += eps
        assert abs((up - down) / (2 * eps) - grads[name][1, 2]) < 1e-3


def test_language_held_out(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(d).select("doc_id", "text", "lang")
    out = language.with_language(spark, docs.withColumnRenamed("lang", "truth"), fit_on=docs).where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert sum(r["lang_pred"] == r["truth"] for r in out) >= 0.95 * len(out)


def test_long_texts_are_read_in_stretches():
    """A stretch gives what the whole text read at once gives, up to what the margin leaves out."""
    rng = np.random.default_rng(5)
    net = language.BiGru(3)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (3, 700, 1500)]
    whole = [net.positions(np.frombuffer(t, np.uint8).astype(np.intp)[:, None]).mean(0)[:, 0] for t in texts]
    assert np.allclose(language.pooled(net, texts, 3), whole, atol=1e-3)


def test_language_of_odd_rows(spark, empty):
    docs = spark.createDataFrame([(k, "the cat sat on the mat and ate", "en", 1) for k in range(20)] + [(100 + k, "中文句子没有空格但是很长" * 3, "zh", 1) for k in range(20)] + [(200 + k, f"der hund und die katze {k}", f"x{k % 70:02d}", 1) for k in range(210)], "doc_id long, text string, lang string, extra int")
    odd = [(900, None), (901, ""), (902, "²½①"), (903, "123 😀 _"), (904, "the cat sat" * 100_000), (None, "the cat sat"), (905, "the cat sat on the mat"), (905, "the cat sat on the mat")]
    model = language.fit(spark, docs)
    assert model[0] == sorted({r["lang"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1})  # no cap on languages
    out = language.with_language(spark, spark.createDataFrame([(*r, None, 7) for r in odd], "doc_id long, text string, lang string, extra int"), model).collect()
    assert [r["lang_pred"] for r in out] == ["und"] * 4 + ["en"] * 4
    assert all(r["extra"] == 7 and 0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in out)
    assert language.fit(spark, empty) is None and language.with_language(spark, empty).count() == 0
    assert {r["lang_pred"] for r in language.with_language(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    ids = spark.createDataFrame([(None,), (1,)], "doc_id long").select(language.held_out(F.col("doc_id")).alias("h"), language.learnable(F.col("doc_id")).alias("l")).collect()
    assert (ids[0]["h"], ids[0]["l"]) == (False, False)
    assert {r["score"] <= 1 for r in language.with_language(spark, docs.withColumn("score", F.lit(7)), model).collect()} == {True}


def test_mixing(spark, docs, empty):
    d = "/root/testdata/sf0.001"
    full = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = mixing.fit_classifier(spark, full, spark.read.parquet(f"{d}/labels.parquet"))
    members = mixing.with_posteriors(spark, full, model).drop("text").cache()
    rate, totals = mixing.fit_rates(members, None, {"high": 0.8, "low": 0.15, "toxic": 0.05})
    assert sum((t["fitted"] - t["target"]) ** 2 for t in totals.values()) < sum((t["now"] - t["target"]) ** 2 for t in totals.values())
    assert members.select(rate.alias("r")).where("r < 0").count() == 0
    assert mixing.fit_classifier(spark, empty, spark.read.parquet(f"{d}/labels.parquet")) is None
    assert mixing.fit_rates(mixing.with_posteriors(spark, empty, None), None, mixing.WEIGHTS)[1] == {}


def test_rates_meet_targets_that_can_be_met(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([3, 0.2, 0.3], 2000)
    members = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(rng.integers(1, 400, 2000), p, strict=True)], "n_tokens long, p_high double, p_low double, p_toxic double").coalesce(2).cache()
    for weights in ({"high": 0.75, "low": 0.25, "toxic": 0.01}, {"high": 0.4, "low": 0.55, "toxic": 0.05}):
        rate, totals = mixing.fit_rates(members, None, weights)
        total = sum(x["now"] for x in totals.values())
        said = members.select(rate.alias("r"), "*").selectExpr("min(r) least", *[f"sum(r * n_tokens * p_{d}) {d}" for d in mixing.DOMAINS]).first()
        assert said["least"] >= 0
        for d, x in totals.items():
            assert abs(said[d] - x["target"]) < 1e-4 * total and abs(said[d] - x["fitted"]) < 1e-6 * total
    assert members.select(mixing.fit_rates(members, None, weights, most=2.0)[0].alias("r")).where("r > 2").count() == 0
