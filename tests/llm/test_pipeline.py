"""The pipeline's stages on odd rows: nulls, empty and repeated texts and ids, extra columns, empty tables."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, value int, row string, key bigint, doc string, _gone string"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bdfghklmnprst") + rng.choice("aeiou") for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, shared, near = prose(40), prose(60), prose(200)
    texts = {i: prose(60) for i in range(60)}
    for i in range(20, 40):
        texts[i] = f"{prose(30)} wretched {prose(30)}"
    texts |= {60: near, 61: near + " tail", 62: near, 63: f"{prose(50)} {shared} {prose(50)}", 64: f"{prose(50)} {shared} {prose(50)}", 65: f"{prose(40)} {item} {prose(40)}", 66: "", 67: None, 68: "x � y"}
    rows = [(i, t, "en", "s", len(t or ""), 1, "r", 2, "d", "g") for i, t in texts.items()]
    rows += [(None, "no id here", None, None, 10, None, None, None, None, None)] * 2 + [rows[5]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(20 <= i < 40)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, shared


def test_stages(spark, folder):
    where, texts, shared = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        if name != "tokens":
            assert out.columns == docs.columns and out.schema == docs.schema
            path = f"{where}/{name}.parquet"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["toxicity"]) == {None, *texts} - set(range(20, 40))
    assert set(kept["near_duplicates"]) == set(kept["toxicity"]) - {61, 62}
    cut = kept["repeated_strings"]
    assert shared not in cut[63] and shared not in cut[64] and cut[5] == "" and cut[68] == texts[68] and cut[67] is None and cut[66] == "" and cut[60] == texts[60]
    assert set(kept["decontamination"]) == set(cut) - {65}
    tokens = out.collect()
    assert len(tokens) == docs.count()
    assert {r["doc_id"]: r["decoded_sha256"] for r in tokens}[68] == hashlib.sha256(texts[68].encode()).hexdigest()


def test_empty_tables(spark, folder, tmp_path):
    where, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
