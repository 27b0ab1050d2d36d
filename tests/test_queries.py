"""A few queries against their SQL twins at the smallest scale (the driver compares them all)."""

import re
import time

import duckdb
import pytest

from spanforge.plans.queries import SQL, Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lines", "sentences", "token_offsets", "align", "clusters", "search_index", "prune", "validate_entities"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = Q[name](spark, D)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_safe_bridge_of_a_long_text(spark, tmp_path):
    line = "Ho  và sốt, đau Gan 😀 x_1.\n"
    texts = {1: line * 15_000, 2: "", 3: " , ", 4: "a", 5: "ab b", 6: None}
    spark.createDataFrame([*texts.items(), (None, "ab b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in texts.items():
        at = [m.span() for m in re.finditer(r"\w+", text or "")]
        for k, (a, b) in enumerate(at):
            if k + (b - a) % 3 + 1 < len(at):
                want.append((doc, k, text[b : at[k + (b - a) % 3 + 1][0]]))
    began = time.time()
    got = Q["safe_bridge"](spark, str(tmp_path)).collect()
    assert time.time() - began < 30  # far more, if the text were met and counted through for each word
    assert sorted((r["doc_id"], r["pos"], r["gap"]) for r in got) == sorted(want)
    said = {r["gap"]: r["reason"] for r in got}
    assert said[" "] == "fragments_overlap_or_touch"
    assert {v for g, v in said.items() if "," in g} == {"bridge_crosses_punctuation_or_newline"}
