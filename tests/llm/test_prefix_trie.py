"""The trie of conversations against brute force over all prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from trialstream.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, path string, part int, base string, h string"


def nodes_of(sequences):
    """sequences: lists of (role, text) by id."""
    members, words = defaultdict(list), {(): 0}
    for c, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                words[tuple(turns[:d])] = len(re.findall(rf"{prefix_trie.WORD}", turns[d - 1][1]))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, own in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(own) - 1) * words[key]
    out = []
    for key, own in members.items():
        ends = ",".join(str(c) for c in own if len(sequences[c]) == len(key))
        out.append((own[0], len(key), members[key[:-1]][0] if key else None, len(own), kids[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def read(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in found.items()}


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", 1, "b", "h") for r in rows], SCHEMA)


def test_random_forests(spark):
    rng = random.Random(2)
    rows = []
    for c in range(300):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d  e\tf"])))
    rows += [(1000 + c, turn, "user", "x y z") for c in range(150) for turn in range(4)]  # a third are copies
    rows += [(2000 + c, turn, "user", f"x {turn if turn < 30 else c}") for c in range(4) for turn in range(40)]
    want = nodes_of(read(rows))
    sequences = prefix_trie.turn_sequences(frame(spark, rows))
    for config in (prefix_trie.TrieConfig(), prefix_trie.TrieConfig(least_ranges=40, fan=3, listed_ids=7), prefix_trie.TrieConfig(least_ranges=1)):
        assert got(prefix_trie.trie(sequences, config)) == want


def test_shared_heads_and_odd_rows(spark):
    long = "w " * 100_000
    rows = [(0, 1, "user", "a"), (0, 0, "user", "b"), (0, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", None), (5, 0, "assistant", long), (5, 1, "u", "é\U0001f600 b")]
    rows += [(None, 0, "user", "no id"), (25, 0, "user", "absent base"), (26, 0, "user", "absent base"), (26, 1, "user", "more"), (3, 0, "1:u", ""), (4, 0, "", "1:u"), (40, 0, "", "")]
    own = read(rows)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    sequences = prefix_trie.with_shared_heads(prefix_trie.turn_sequences(frame(spark, rows)), 20, head, 3)
    assert got(prefix_trie.trie(sequences)) == nodes_of(built)
    assert any(not t for t in built.values())


def test_no_rows(spark):
    assert prefix_trie.trie(prefix_trie.turn_sequences(frame(spark, [(None, 0, "user", "no id")]))).collect() == []


def test_common_turns():
    rng = random.Random(5)
    for _ in range(500):
        a, b = (b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(9))) for _ in range(2))
        n = 0
        while n < min(len(a), len(b)) // 16 and a[16 * n : 16 * n + 16] == b[16 * n : 16 * n + 16]:
            n += 1
        assert prefix_trie.common_turns(a, b) == n
