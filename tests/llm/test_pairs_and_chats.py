"""Hard negatives and chat formatting against brute force, on odd rows, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import math
import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trialstream.llm import chat_format, hard_negatives, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = queries.queries()[name](spark, SF_DIR)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(want.fetchall())


def mined(rows, config, is_anchor):
    """What mine() returns, by looking at all pairs."""
    own = [(i, label, [math.floor(config.scale * float(x)) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (anchor, label, q) in enumerate(own):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(sum(x * y for x, y in zip(q, r, strict=False)), i, own_label) for b, (i, own_label, r) in enumerate(own) if b != a]
        for p, i, _ in sorted((x for x in scored if x[2] == label), key=lambda x: key(*x[:2]))[: config.positives]:
            fits = sorted((x for x in scored if x[2] != label and config.low_percent * p <= 100 * x[0] <= config.high_percent * p), key=lambda x: key(*x[:2]))
            out += [(anchor, i, k + 1, n, p, s) for k, (s, n, _) in enumerate(fits[: config.negatives])]
    return sorted(out, key=repr)


def got_mined(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, q int, anchor string, id string, codes string"


def test_four_russians_scores():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 2**28):
        own, anchors = rng.integers(-top, top + 1, (50, 24)), rng.integers(-top, top + 1, (7, 24))
        own[0], own[1], anchors[0] = -top, top, -top
        codes = hard_negatives.bit_planes(own, top.bit_length() + 1)
        assert (hard_negatives.scores(codes, hard_negatives.subset_sums(anchors, np.int64)) == own @ anchors.T).all()


def test_mine_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-2, 3, 10) / 4]) for i in range(120)]
    rows += [(i, 1, [0.5] * 10) for i in range(200, 240)]  # ties, a third of the rows
    rows += [(7, None, [0.5] * 10), (300, 1, None), (301, 1, [None] * 10), (302, 1, [float("nan")] * 10), (303, 2, [float("inf")] + [0.0] * 9), (304, 2, []), (305, 0, [0.5] * 13), (None, 0, [0.5] * 10), (310, -5, [0.25] * 10), (330, 0, [-0.001] * 3)]
    config = hard_negatives.MiningConfig(block_rows=20, block_anchors=9, least_blocks=3, table_anchors=4, scored_rows=8)
    df = spark.createDataFrame([(*r[:1], r[2], r[1], "a", 1, "b", "c", "d") for r in rows], SCHEMA)
    want = mined(rows, config, lambda i: i % 10 == 0)
    assert got_mined(hard_negatives.mine(df, config, is_anchor=F.col("id") % 10 == 0)) == want and len(want) > 50
    assert got_mined(hard_negatives.mine(df, is_anchor=F.col("id") % 10 == 0)) == want


def test_mine_repeated_and_empty(spark):
    rows = [(1, 0, [1.0, 0.0])] * 3 + [(2, 1, [0.75, 0.0])] * 4 + [(3, 1, [0.5, 9.0])]
    df = spark.createDataFrame([(*r[:1], r[2], r[1], "a", 1, "b", "c", "d") for r in rows], SCHEMA)
    assert got_mined(hard_negatives.mine(df)) == mined(rows, hard_negatives.MiningConfig(), lambda i: True)
    assert hard_negatives.mine(df.limit(0)).collect() == []
    assert hard_negatives.mine(df, is_anchor=F.lit(False)).collect() == []


def test_mine_values_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e18], 1, "a", 1, "b", "c", "d")], SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(df)


TURNS = "conv_id bigint, turn bigint, role string, text string, parts string, target int, formatted string"


def test_chats(spark):
    odd = ["", None, "</s>", "[INST]", "[\\INST] [\\\\/INST]", "<\\/s>[/INST]", "</s</s>>", "[[/INST]]", "é\U0001f600</s>\n", "x" * 200_000 + "</s>", "\\1$1\\"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)]
    rows += [(2, None, None, "first"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, 0, "[/INST]</s>", "role"), (3, 0, "system", "no reply"), (4, 0, "assistant", ""), (None, 0, "assistant", "no id"), (5, 0, "assistant", "opens"), (5, 1, "user", "ends")]
    df = spark.createDataFrame([(*r, "p", 1, "f") for r in rows], TURNS)
    examples = chat_format.examples(df)
    seen: dict = {}
    for c, turn, role, text in rows:
        seen.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    back = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    assert set(back) == set(seen)
    got: dict = {}
    for r in examples.collect():
        got.setdefault(r["conv_id"], {})[r["target"]] = r
    for c, turns in seen.items():
        turns.sort()
        text = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        r = back[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        targets = [k + 1 for k, t in enumerate(turns) if t[2] == "assistant" or k + 1 == len(turns)]
        assert sorted(got[c]) == targets and r["n_examples"] == len(targets)
        assert r["formatted_chars"] == sum(len(x["formatted"]) for x in got[c].values())
        for k, x in got[c].items():
            assert x["formatted"].count("</s>") == x["formatted"].count("[INST]") == x["formatted"].count("[/INST]") == k
            own = x["formatted"][x["loss_start"] : x["loss_start"] + x["loss_chars"]]
            assert x["formatted"][x["loss_start"] + x["loss_chars"] :] == ("</s>" if turns[k - 1][2] == "assistant" else x["formatted"][x["loss_start"] :])
            assert (own == "") if turns[k - 1][2] != "assistant" else own.replace("\\", "") == turns[k - 1][3].replace("\\", "")
    assert chat_format.examples(df.limit(0)).collect() == []
