"""Prefix trie of conversations by union-find over sorted neighbours.

Conversations are sequences of turn digests; equal ones are one sequence with its members counted. Sequences are sorted and dealt into
ranges. In a range, the edges between neighbours are taken in descending order of their longest common prefix; each merges
two components, at a branching node as deep as that prefix, and the turns below it that only one component has become nodes of
one child. What a range shares with its neighbours stays open: the range is contracted to its first and its last path, whose
turns carry what hangs on them, and contracted ranges are merged by the same rule, some at a time, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, released, ship, written

#: Bytes of a turn's digest.
DIGEST = 16
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class TrieConfig:
    #: Turns of a range, on average.
    range_turns: int = 200_000
    #: Ranges at least, so that small tables use all cores.
    least_ranges: int = 32
    #: Contracted ranges that are merged at a time.
    fan: int = 16
    #: Ids of one sequence that are listed in one row.
    listed_ids: int = 4096


@dataclass(slots=True)
class Load:
    """What is known of a node without the open nodes below it: members, the smallest one, leaves, children, tokens saved, the sequence that ends at it and its members."""

    n: int = 0
    conv: int | None = None
    leaves: int = 0
    kids: int = 0
    saved: int = 0
    end: int | None = None
    end_n: int = 0

    def add(self, other: Load) -> None:
        self.n += other.n
        self.conv = other.conv if self.conv is None else self.conv if other.conv is None else min(self.conv, other.conv)
        self.leaves += other.leaves
        self.kids += other.kids
        self.saved += other.saved
        if other.end is not None:
            self.end, self.end_n = other.end, other.end_n


@dataclass(slots=True)
class Path:
    """A sequence, or an end of a contracted range: words of each turn (from depth 1), loads by depth, ids of open nodes by depth."""

    words: list[int]
    loads: dict[int, Load]
    key: bytes | None = None
    ids: list[bytes] = field(default_factory=list)

    def id(self, depth: int) -> bytes:
        return self.ids[depth] if self.key is None else hashlib.blake2b(self.key[: DIGEST * depth], digest_size=DIGEST).digest()


@dataclass(slots=True)
class Component:
    """Neighbouring paths low to high, joined down to depth; load: of the node there; rest: of those above it; waiting: rows of its children."""

    low: int
    high: int
    depth: int
    load: Load
    rest: dict[int, Load]
    waiting: list[int]


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    if a[: DIGEST * n] == b[: DIGEST * n]:
        return n
    low, high = 0, n  # the first low turns agree, the first high ones don't
    while high - low > 1:
        mid = (low + high) // 2
        if a[DIGEST * low : DIGEST * mid] == b[DIGEST * low : DIGEST * mid]:
            low = mid
        else:
            high = mid
    return low


NODE = ("depth", "id", "n", "conv", "leaves", "kids", "saved", "end", "end_n", "parent_conv", "parent_id")


def contract(paths: list[Path], common: list[int], left: int, right: int) -> tuple[list[list], list[dict[int, Load]]]:
    """Nodes that are complete (rows as NODE says), and the loads by depth of those that stay open, of the first and the last path.

    common: turns that each path shares with the next; left, right: depth down to which the first path is shared with what comes before,
    the last path with what comes after (-1: nothing is there).
    """
    nodes: list[list] = []
    spines: list[dict[int, Load]] = [{}, {}]
    last = len(paths) - 1
    above = list(range(len(paths)))
    parts = [Component(i, i, len(p.words), p.loads.pop(len(p.words), Load()), p.loads, []) for i, p in enumerate(paths)]

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def lift(c: Component, depth: int) -> None:
        """Make the component's nodes that are deeper than depth."""
        while c.depth > depth:
            d, load, path = c.depth, c.load, paths[c.low]
            on_left = c.low == 0 and d <= left
            if on_left or (c.high == last and d <= right):
                spines[0 if on_left else 1][d] = load
                path = path if on_left else paths[last]
                for row in c.waiting:
                    nodes[row][10] = path.id(d)
                c.load, c.waiting = Load(), []
            else:
                saved = load.saved + (load.n - 1) * (path.words[d - 1] if d else 0)
                for row in c.waiting:
                    nodes[row][9] = load.conv
                c.load, c.waiting = Load(load.n, load.conv, load.leaves, 1, saved), [len(nodes)]
                nodes.append([d, path.ids[d] if path.ids else None, load.n, load.conv, load.leaves, load.kids, saved, load.end, load.end_n, None, None])
            c.depth = d - 1
            if c.depth in c.rest:
                c.load.add(c.rest.pop(c.depth))

    for edge in sorted(range(last), key=lambda i: -common[i]):
        i, j = find(edge), find(edge + 1)
        a, b = parts[i], parts[j]
        lift(a, common[edge])
        lift(b, common[edge])
        a.load.add(b.load)
        for depth, load in b.rest.items():
            a.rest.setdefault(depth, Load()).add(load)
        a.waiting, more = (a.waiting, b.waiting) if len(a.waiting) >= len(b.waiting) else (b.waiting, a.waiting)
        a.waiting += more
        a.high = b.high
        above[j] = i
    lift(parts[find(0)], -1)
    return nodes, spines


_KIND = "part int, side int, depth int, id binary, n bigint, conv bigint, leaves bigint, kids bigint, saved bigint, end bigint, end_n bigint, parent_conv bigint, parent_id binary, words bigint, before int, after int, inner int"
_SCHEMA = pa.schema([(c, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in _KIND.split(", "))])


def _rows(part: int, paths: list[Path], common: list[int], left: int, right: int) -> pa.Table:
    """Complete nodes (side null) and the turns of the contracted range's paths as a table."""
    inner = min([len(paths[0].words), len(paths[-1].words), *common])
    nodes, spines = contract(paths, common, left, right)
    out = [[part, None, *row, None, None, None, None] for row in nodes]
    for side, path, depth in ((0, paths[0], left), (1, paths[-1], right)):
        for d in range(depth + 1):
            load = spines[side].get(d) or Load()
            out.append([part, side, d, path.id(d), load.n, load.conv, load.leaves, load.kids, load.saved, load.end, load.end_n, None, None, path.words[d - 1] if d else 0, left, right, min(inner, left, right)])
    columns = list(zip(*out, strict=True)) or [[]] * len(_SCHEMA)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _of_sequences(rows: pa.Table, around: pa.Table) -> pa.Table:
    """A range of sequences (part, path, words, n, conv), contracted; around: the neighbouring ranges' nearest paths."""
    rows = rows.sort_by("path")
    keys, own, n, conv = (rows[c].to_pylist() for c in ("path", "words", "n", "conv"))
    before, after = (around[c][0].as_py() for c in ("before", "after"))
    common = [common_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    left, right = (-1 if x is None else common_turns(x, k) for x, k in ((before, keys[0]), (after, keys[-1])))
    paths = []
    for i, key in enumerate(keys):
        turns = len(own[i])
        goes_on = (common[i] if i < len(common) else right) == turns
        paths.append(Path(own[i], {turns: Load(n[i], conv[i], int(not goes_on), 0, 0, conv[i], n[i])}, key))
    return _rows(rows["part"][0].as_py(), paths, common, left, right)


def _of_ranges(rows: pa.Table, fan: int) -> pa.Table:
    """Contracted ranges that lie side by side, contracted to one."""
    paths, common, spans = [], [], []
    last = None
    for r in rows.sort_by([("part", "ascending"), ("side", "ascending"), ("depth", "ascending")]).to_pylist():
        if last is None or (last["part"], last["side"]) != (r["part"], r["side"]):
            if last is not None:
                common.append(r["inner"] if last["part"] == r["part"] else r["before"])
            paths.append(Path([], {}))
            spans.append((r["before"], r["after"]))
        if r["depth"]:
            paths[-1].words.append(r["words"])
        paths[-1].ids.append(r["id"])
        paths[-1].loads[r["depth"]] = Load(r["n"], r["conv"], r["leaves"], r["kids"], r["saved"], r["end"], r["end_n"])
        last = r
    return _rows(rows["part"][0].as_py() // fan, paths, common, spans[0][0], spans[-1][1])


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, digest, words), of each conversation with an id: by turn, null first, then digest.

    digest is half of the SHA-256 of a turn's role and text, in hex; a null role or text is empty. words counts its words.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(sequences: DataFrame, family: int, head: Column, longest: int) -> DataFrame:
    """sequences whose first head turns (at most longest) are those of conversation conv_id - conv_id % family, as far as there are so many, in place of their own."""
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = sequences.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("first"))
    rows = sequences.withColumns({"h": head.cast("int"), "base": base}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("first", 1, F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _end_digests(members: DataFrame, config: TrieConfig) -> DataFrame:
    """(end, ends_sha256) of (path, conv_id): the digest of the ids of each sequence, by its smallest id. A sequence's ids are listed in parts and hashed as they pass."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, state = None, None, None
        for batch in batches:
            ends, digests = [], []
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if path != key:
                    if state is not None:
                        ends.append(first)
                        digests.append(state.hexdigest())
                    key, first, state = path, ids[0], hashlib.sha256()
                    state.update(",".join(map(str, ids)).encode())
                else:
                    state.update("".join(f",{i}" for i in ids).encode())
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(digests, pa.string())], ["end", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([state.hexdigest()])], ["end", "ends_sha256"])

    slot = F.floor(F.col("conv_id") / config.listed_ids)
    rows = members.groupBy(F.md5("path").alias("path"), slot.alias("slot")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return rows.repartition("path").sortWithinPartitions("path", "slot").mapInArrow(run, "end bigint, ends_sha256 string")


def trie(sequences: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every distinct prefix of the sequences (conv_id, turns).

    A node is named by its smallest member and its depth; the root has depth 0 and no parent. Members are the conversations that start with
    it, saved_tokens sums (members - 1) times the words of the last turn over its subtree, and the ends are the members that are no longer than it.
    A conversation without turns is a member of the root; without conversations there is no node. conv_id must be unique and not null,
    as turn_sequences makes it. A conversation's digests (20 bytes a turn) are one row; ids of equal conversations are hashed part by part.
    """
    spark = sequences.sparkSession
    ship(spark)
    members = written(sequences.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words")), "sequences")
    unique = members.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("words").alias("words"))
    about = members.agg(F.sum(F.size("words") + 1).alias("turns")).first()
    ranges = max(config.least_ranges, -(-(about["turns"] or 0) // config.range_turns))
    dealt = unique.repartitionByRange(ranges, "path").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    # a row for each range: from its neighbours it needs the nearest path only
    bounds = dealt.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    bounds = bounds.selectExpr("part", "lag(high) over (order by part) as before", "lead(low) over (order by part) as after")
    found = written(dealt.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(_of_sequences, _KIND), "forests")
    levels, fan = [found], config.fan
    last = found.agg(F.max("part")).first()[0] or 0
    while last > 0:
        group = F.floor(F.col("part") / fan).cast("int").alias("group")
        found = written(found.where("side is not null").groupBy(group).applyInArrow(lambda t: _of_ranges(t, fan), _KIND), "forests")
        levels.append(found)
        last //= fan
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = nodes.where("side is null").drop("side", "words", "before", "after", "inner", "part")
    # children of nodes that were open when they were made
    open_nodes = nodes.where("id is not null").select(F.col("id").alias("parent_id"), F.col("conv").alias("late"), F.col("kids").alias("n"))
    late = join_hot(nodes.where("parent_id is not null"), open_nodes, "parent_id", max(1, about["turns"] or 1)).withColumn("parent_conv", F.col("late")).select(*nodes.columns)
    every = nodes.where("parent_id is null").unionByName(late)
    several = _end_digests(members.join(dealt.where("n > 1").select("path"), "path", "left_semi"), config)
    one = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)
    plain = every.where("end_n <= 1").withColumn("ends_sha256", one)
    shared = every.where("end_n > 1").join(several, "end").select(*plain.columns)
    return plain.unionByName(shared).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
