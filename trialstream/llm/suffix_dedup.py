"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Which suffixes. Every window of LENGTH bytes has an anchor: the start of its K-byte string of
lowest hash, the leftmost of equal ones. Equal windows have the same anchor at the same
offset, so it is enough to sort the suffixes that start at anchors, with the text left of
them kept beside. An anchor whose K bytes occur once in the corpus can't be part of a repeat
and goes no further.

Sort. Each task sorts the suffixes of its rows, writes the distinct ones as front-coded runs
(length of the prefix shared with the suffix before, and the rest) and cuts them at splitters.
A run's piece goes to the task of its range, where a loser tree merges the pieces: of two
suffixes whose common prefixes with the last output differ, the longer prefix wins
without a look at a byte, and equal prefixes are compared only beyond them. The merge yields the
prefix that each suffix shares with the one before.

Repeats. A window that starts o bytes left of its anchor is repeated if another suffix shares
its first LENGTH - o bytes, which the merged order tells, and its last o bytes on the left,
which the order of the reversed left sides tells.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, released, ship, written


@dataclass(frozen=True)
class RepeatConfig:
    #: Length in bytes of the strings that are removed where they occur more than once.
    length: int = 200
    #: Length of the string that selects an anchor.
    anchor: int = 48
    #: Bytes of suffixes that one merging task should get.
    range_bytes: int = 12_000_000


_CHUNK = 1 << 20


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code for each byte, and the powers of an odd base and of its inverse."""
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
    return codes, up, down


def anchors(data: bytes, ends: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first window, last window) of each run of windows with one anchor.

    data holds several texts one after the other, at most _CHUNK bytes, which end at ends; windows don't cross them.
    """
    n, k, length = len(data), config.anchor, config.length
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty
    codes, up, down = _powers(_CHUNK)
    raw = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[raw] * up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    place = np.uint64(_CHUNK - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    width, step = length - k + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    starts = np.concatenate([[0], ends[:-1]])
    allowed = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    allowed[starts[long]] += 1
    allowed[ends[long] - length + 1] -= 1
    window = np.flatnonzero(np.cumsum(allowed[: len(low)]))
    at = (low[window] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])) if len(at) else empty
    last = np.concatenate([new[1:], [len(at)]])[: len(new)] - 1
    return h[at[new]], at[new], window[new], window[last]


def _pieces(data: bytes, config: RepeatConfig) -> Iterator[tuple[bytes, int]]:
    """data in pieces of less than _CHUNK bytes, with their places; every window lies in one of them."""
    for offset in range(0, max(1, len(data) - config.length + 1), _CHUNK - config.length):
        piece = data[offset : offset + _CHUNK - 1]
        if len(piece) >= config.length:
            yield piece, offset


def anchor_grams(docs: DataFrame, config: RepeatConfig) -> DataFrame:
    """(key, gram) of every anchor of (key, text): the hash of the bytes at the anchor."""

    def flush(keys: list[int], parts: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum(np.array(list(map(len, parts)), np.int64))
        gram, at, _, _ = anchors(b"".join(parts), ends, config)
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[np.searchsorted(ends, at, "right")]), pa.array(gram.view(np.int64))], ["key", "gram"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            parts: list[bytes] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece, _ in _pieces(text.as_buffer().to_pybytes(), config):
                    if held + len(piece) >= _CHUNK:
                        yield flush(keys, parts)
                        keys, parts, held = [], [], 0
                    keys.append(key)
                    parts.append(piece)
                    held += len(piece)
            if parts:
                yield flush(keys, parts)

    return docs.mapInArrow(run, "key bigint, gram bigint")


def with_spots(texts: DataFrame, config: RepeatConfig) -> DataFrame:
    """texts with their column grams, which comes last, replaced by spots: anchor, first and last window of each anchor with one of the grams."""
    names = texts.columns[:-1]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = []
            for text, grams in zip(batch.column("text"), batch.column("grams"), strict=True):
                wanted, own = grams.values.to_numpy(), []
                for piece, offset in _pieces(text.as_buffer().to_pybytes(), config):
                    gram, *places = anchors(piece, np.array([len(piece)], np.int64), config)
                    near = np.isin(gram.view(np.int64), wanted)
                    own += [{"at": a, "first": f, "last": z} for a, f, z in zip(*((x[near] + offset).tolist() for x in places), strict=True)]
                spots.append(own)
            kind = pa.list_(pa.struct([("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spots, kind)], [*names, "spots"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{fields}, spots array<struct<at: int, first: int, last: int>>")


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to start."""
    n = min(len(a), len(b))
    while start < n:
        stop = min(n, start + 64)
        x = int.from_bytes(a[start:stop], "big") ^ int.from_bytes(b[start:stop], "big")
        if x:
            return stop - (x.bit_length() + 7) // 8
        start = stop
    return n


def front_code(entries: list[tuple[bytes, int, int]]) -> bytes:
    """Sorted (string, right length, count) entries as compressed bytes: each without the prefix it shares with the one before."""
    import zstandard

    out, last = [], b""
    for string, right, count in entries:
        shared = common_prefix(last, string)
        out.append(struct.pack("<HHHI", shared, len(string) - shared, right, count) + string[shared:])
        last = string
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def decode_run(data: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(prefix shared with the entry before, string, right length, count) of each entry."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    place, last = 0, b""
    while place < len(data):
        shared, rest, right, count = struct.unpack_from("<HHHI", data, place)
        place += 10
        last = last[:shared] + data[place : place + rest]
        place += rest
        yield shared, last, right, count


class LoserTree:
    """Merges sorted front-coded runs; yields (prefix shared with the output before, string, right length, count).

    Every entry in the tree carries the length of the prefix that it shares with the last output.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, int, int]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then carries the prefix that it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[1], y[1]
        n = common_prefix(s, t, p)
        if n == len(s) == len(t):
            first = (x[2], a) <= (y[2], b)
        else:
            first = n == len(s) or n < len(t) and s[n] < t[n]
        winner, loser = (a, b) if first else (b, a)
        self.shared[loser] = n
        return winner, loser

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        while (head := self.heads[self.winner]) is not None:
            at = self.winner
            yield self.shared[at], head[1], head[2], head[3]
            new = self.heads[at] = next(self.runs[at], None)
            self.shared[at] = new[0] if new else 0
            node = (at + self.size) // 2
            while node:
                at, self.losers[node] = self._play(at, self.losers[node])
                node //= 2
            self.winner = at


def _suffix(data: bytes, at: int, first: int, last: int, length: int) -> tuple[bytes, int]:
    """(bytes from the anchor to the end of its last window, then those back to its first window reversed; how many are right)."""
    right = data[at : last + length]
    return right + data[first:at][::-1], len(right)


def _digest(string: bytes, right: int) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(string, seed=right)


def repeated_offsets(strings: list[bytes], right: np.ndarray, count: np.ndarray, shared: np.ndarray, config: RepeatConfig) -> list[list[tuple[int, int]]]:
    """For each of the sorted distinct strings, the ranges of offsets whose windows occur more than once.

    shared: the common prefix with the string before. right: how many bytes of each stand right of its anchor.
    """
    n, length, k = len(strings), config.length, config.anchor
    left = np.array([len(s) for s in strings], np.int64) - right
    group = np.cumsum(shared < k)
    sizes = np.bincount(group)[group]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i in np.flatnonzero(count > 1):
        out[i] = [(length - int(right[i]), int(left[i]))]
    rows = np.flatnonzero(sizes > 1)
    if not len(rows) or not (count[rows] == 1).any():
        return out
    shared = shared[rows]  # a group's first row shares less than an anchor with the row before, kept or not
    lefts = [strings[i][right[i] :] for i in rows]
    order = sorted(range(len(rows)), key=lefts.__getitem__)
    left_shared = np.zeros(len(rows), np.int64)
    for j in range(1, len(order)):
        left_shared[j] = common_prefix(lefts[order[j - 1]], lefts[order[j]])
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    single = count[rows] == 1
    own_right, own_left, own_count = right[rows], left[rows], count[rows]
    hit = np.zeros((len(rows), length - k + 1), bool)
    for o in range(length - k + 1):
        part = np.flatnonzero((own_right >= length - o) & (own_left >= o))
        if len(part) < 2:
            continue
        by_right = np.cumsum(shared < length - o)[part]
        by_left = np.cumsum(left_shared < o)[rank[part]]
        both = by_right * (len(rows) + 1) + by_left
        sort = np.argsort(both, kind="stable")
        ordered = both[sort]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.add.reduceat(own_count[part[sort]], edge)
        hit[part[sort], o] = np.repeat(total > 1, np.diff(np.concatenate([edge, [len(part)]])))
    for j in np.flatnonzero(hit.any(axis=1) & single):
        turn = np.flatnonzero(np.diff(np.concatenate([[0], hit[j].astype(np.int8), [0]])))
        out[rows[j]] = [(int(a), int(b) - 1) for a, b in zip(turn[::2], turn[1::2], strict=True)]
    return out


def sorted_runs(texts: DataFrame, splitters: list[bytes], config: RepeatConfig) -> DataFrame:
    """(part, run): front-coded sorted runs of the suffixes of (text, spots), cut at the splitters."""

    def cut(found: dict[tuple[bytes, int], int]) -> Iterator[tuple[int, bytes]]:
        entries = sorted((s, right, n) for (s, right), n in found.items())
        keys = [e[0] for e in entries]
        edges = [0, *(bisect_left(keys, s) for s in splitters), len(entries)]
        for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                yield part, front_code(entries[a:b])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, int], int] = {}
        size = 0
        for batch in batches:
            for text, spots in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for spot in spots:
                    own = _suffix(data, spot["at"], spot["first"], spot["last"], config.length)
                    if own in found:
                        found[own] += 1
                    else:
                        found[own] = 1
                        size += len(own[0]) + 150
                if size > 150_000_000:
                    yield _run_rows(list(cut(found)))
                    found, size = {}, 0
        if found:
            yield _run_rows(list(cut(found)))

    return texts.select("text", "spots").mapInArrow(run, "part int, run binary")


def _run_rows(pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.int32()), pa.array([r for _, r in pieces], pa.binary())], ["part", "run"])


def merged_repeats(runs: DataFrame, parts: int, config: RepeatConfig) -> DataFrame:
    """(digest, ranges) of every distinct suffix with a repeated window: pairs of offsets, one after the other."""

    def work(pieces: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        strings: list[bytes] = []
        right: list[int] = []
        count: list[int] = []
        shared: list[int] = []

        def solve() -> Iterator[tuple[bytes, list[int]]]:
            found = repeated_offsets(strings, np.array(right, np.int64), np.array(count, np.int64), np.array(shared, np.int64), config)
            for s, r, ranges in zip(strings, right, found, strict=True):
                if ranges:
                    yield _digest(s, r), [x for pair in ranges for x in pair]

        low = 1 << 30  # prefix shared with the last kept string
        for n, s, r, c in LoserTree([decode_run(p) for p in pieces]):
            low = min(low, n)
            if strings and low >= len(s) == len(strings[-1]) and r == right[-1]:
                count[-1] += c
                low = 1 << 30
                continue
            if strings and low < config.anchor and len(strings) >= 20_000:  # between two groups
                yield from solve()
                for own in (strings, right, count, shared):
                    own.clear()
            strings.append(s)
            right.append(r)
            count.append(c)
            shared.append(low if len(strings) > 1 else 0)
            low = 1 << 30
        if strings:
            yield from solve()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces.setdefault(part, []).append(data)
        for part in sorted(pieces):
            rows = list(work(pieces.pop(part)))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([r for _, r in rows], pa.list_(pa.int32()))], ["digest", "ranges"])

    return runs.repartition(parts, "part").mapInArrow(run, "digest binary, ranges array<int>")


def _key(columns: list[Column]) -> list[Column]:
    """Two hashes of a row."""
    return [F.xxhash64(*columns).alias("key"), F.xxhash64(F.lit(1), *columns).alias("key2")]


def _struct(columns: list[Column]) -> Column:
    return F.struct(*columns) if columns else F.struct(F.lit(0).alias("_none"))


def repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), *, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts holds the rows of docs with an anchor that recurs, under a row number, rid, in the columns
    rid, row (a struct of docs' other columns), text; spans has (rid, spans), the byte ranges (start, stop) that go, which may overlap.
    """
    spark = docs.sparkSession
    ship(spark)
    others = [docs[c] for c in docs.columns if c != text_column]
    keyed = docs.select(_key([*others, docs[text_column]])[0].alias("key"), _struct(others).alias("row"), F.col(text_column).cast("string").alias("text"))
    long = keyed.where(F.octet_length("text") >= config.length)
    found = written(anchor_grams(long.select("key", "text"), config), "anchors")
    again = written(found.groupBy("gram").agg(F.count("*").alias("n"), F.lit(True).alias("again")).where("n > 1"), "recurring")
    grams = join_hot(found, again, "gram", found.count()).where("again").groupBy("key").agg(F.collect_set("gram").alias("grams"))
    texts = written(with_spots(long.join(grams, "key").select(F.monotonically_increasing_id().alias("rid"), "row", "text", "grams"), config), "anchored")
    total = texts.agg(F.sum(F.size("spots"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 300 // config.range_bytes))
    splitters = _splitters(texts, total, parts, config)
    merged = written(merged_repeats(sorted_runs(texts, splitters, config), parts, config), "repeats")

    @released
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, digests, at = [], [], []
            for rid, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for s in own:
                    rids.append(rid)
                    digests.append(_digest(*_suffix(data, s["at"], s["first"], s["last"], config.length)))
                    at.append(s["at"])
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(digests, pa.binary()), pa.array(at, pa.int32())], ["rid", "digest", "at"])

    named = texts.select("rid", "text", "spots").mapInArrow(name, "rid bigint, digest binary, at int")
    ranges = named.join(merged, "digest").select("rid", "at", F.posexplode("ranges").alias("k", "lo"), "ranges").where("k % 2 = 0")
    span = F.struct((F.col("at") - F.element_at("ranges", F.col("k") + 2)).alias("start"), (F.col("at") - F.col("lo") + config.length).alias("stop"))
    spans = written(ranges.select("rid", span.alias("span")).groupBy("rid").agg(F.collect_list("span").alias("spans")), "spans")
    return texts.select("rid", "row", "text"), spans


def _splitters(texts: DataFrame, total: int, parts: int, config: RepeatConfig) -> list[bytes]:
    """Strings of anchor length that cut the suffixes into about equal ranges, from a bounded sample of 64 for each range."""
    every = max(1, total // (64 * parts))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            out = []
            for text, spots in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                take = [s["at"] for i, s in enumerate(spots, seen) if i % every == 0]
                seen += len(spots)
                if take:
                    data = text.as_buffer().to_pybytes()
                    out += [data[a : a + config.anchor] for a in take]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["s"])

    sample = sorted({bytes(r[0]) for r in texts.select("text", "spots").mapInArrow(run, "s binary").collect()})
    return [sample[i * len(sample) // parts] for i in range(1, parts)] if len(sample) >= parts else sample[1:]


def _cutter(whole_characters: bool):
    """(row, text, spans) to (row, n_bytes, n_removed, n_spans, kept)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if whole_characters:  # a byte 10xxxxxx isn't the first of its character
                        while data[a] & 0xC0 == 0x80:
                            a -= 1
                        while b < len(data) and data[b] & 0xC0 == 0x80:
                            b += 1
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for span in merged for x in span), len(data)]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in merged))
                counts.append(len(merged))
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), *, text_column: str = "text", digest: bool = False, whole_characters: bool = False) -> DataFrame:
    """For every row of docs: row (a struct of docs' columns but text_column), n_bytes, n_removed, n_spans (removed runs) and
    kept (the remaining bytes; null for a null text), or kept_sha256 in place of kept if digest is set.

    A byte goes if a string of config.length bytes covers it that starts anywhere else too, in the same text
    or another. Null texts count as empty. Repeated rows are copies of each other. With whole_characters, a character
    of which a byte goes is removed whole, so what is kept is text.
    """
    texts, spans = repeats(docs, config, text_column=text_column)
    others = [docs[c] for c in docs.columns if c != text_column]
    row_type = texts.schema["row"].dataType.simpleString()
    cut = texts.join(spans, "rid").select("row", "text", "spans").mapInArrow(_cutter(whole_characters), f"row {row_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    if digest:
        cut = cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    text = F.col(text_column).cast("string")
    data = F.coalesce(text, F.lit("")).cast("binary")
    none = F.lit(0).cast("bigint")
    plain = docs.select(_struct(others).alias("row"), F.octet_length(data).cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256") if digest else text.cast("binary").alias("kept"), *_key([*others, docs[text_column]]))
    gone = texts.join(spans.select("rid"), "rid").select(*_key([*([F.col("row")[c] for c in docs.columns if c != text_column]), F.col("text")])).distinct()
    return plain.join(gone, ["key", "key2"], "left_anti").drop("key", "key2").unionByName(cut)
