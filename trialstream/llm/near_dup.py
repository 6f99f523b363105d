"""Near duplicates by MinHash bands and sequential Bayesian verification.

Texts with equal shingle sets form one class, so exact copies are handled once. Classes
that share a band of their MinHash signature are candidates. Within a bucket not all
pairs are compared: first each class with the bucket's leader, the member that shares most buckets;
then, of buckets whose classes aren't yet in one component, those pairs of different components that an
exact filter leaves: similar sets share one of their rarest shingles, at places that leave room for enough
others. So a large group of near copies costs little more than its members. A pair's signatures are compared in batches and the
pair is dropped when the posterior probability of a similarity over the threshold falls
under the chosen miss probability; survivors are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, released, ship, written

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDupConfig:
    words: int = 5
    #: Similarity in per cent at which documents are linked.
    percent: int = 80
    bands: int = 32
    rows: int = 6
    #: Hashes compared at a time, and the probability at which a pair is given up.
    batch: int = 24
    miss: float = 1e-6
    seed: int = 11
    #: Shingles whose frequency orders the others in the exact filter. Any order gives all pairs; a good one gives few others.
    ordered_shingles: int = 200_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordCodes(dict):
    """64-bit codes of words, kept by word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: str, size: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of its whole word sequence if it has fewer words; none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(own))
    n = len(own) - size + 1
    with np.errstate(over="ignore"):
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = (h ^ own[k : k + n]) * _MIX
            h ^= h >> np.uint64(31)
    return np.unique(h)


@cache
def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, (count, 1), np.uint32), rng.integers(0, 1 << 32, (count, 1), np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, config: NearDupConfig) -> np.ndarray:
    flip, factor = _functions(config.bands * config.rows, config.seed)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        out = np.minimum(out, ((low[i : i + 2048] ^ flip) * factor).min(axis=1))
    return out


def band_keys(own: np.ndarray, config: NearDupConfig) -> np.ndarray:
    bands = own.reshape(config.bands, config.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, config.bands + 1, dtype=np.uint64) * _MIX
        for k in range(config.rows):
            h = (h ^ bands[:, k]) * _MIX
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


@cache
def least_matches(total: int, batch: int, percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(compared, matches): after so many compared 8-bit hashes, a pair with fewer matches is given up."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(batch, total + 1, batch):
        need = 0
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= percent / 100].sum() >= miss * weight.sum():
                need = m
                break
        out.append((n, need))
    return tuple(out)


def sketches(docs: DataFrame, config: NearDupConfig, id_column: str, text_column: str) -> DataFrame:
    """(id, n, digest, bands, sig) of every row; digest and what follows are null without shingles."""
    kind = docs.schema[id_column].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        codes = WordCodes()
        for batch in batches:
            counts, digests, bands, sigs = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py() or "", config.words, codes)
                counts.append(len(shingles))
                if not len(shingles):
                    digests.append(None)
                    bands.append(None)
                    sigs.append(None)
                    continue
                own = signature(shingles, config)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bands.append(band_keys(own, config))
                sigs.append(own.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "n", "digest", "bands", "sig"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string")).mapInArrow(run, f"id {kind}, n bigint, digest binary, bands array<bigint>, sig binary")


def _pruned(pairs: DataFrame, sigs: DataFrame, config: NearDupConfig) -> DataFrame:
    """Pairs (a, b) that the sequential comparison of signatures leaves."""
    kind = pairs.schema["a"].dataType.simpleString()
    steps = least_matches(config.bands * config.rows, config.batch, config.percent, config.miss)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, need in steps:
                matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= need], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    own = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return own.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, texts: DataFrame, config: NearDupConfig) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, last, other = WordCodes(), None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py()
                if b != last:
                    last, other = b, shingle_set(batch.column(3)[i].as_py() or "", config.words, codes)
                own = shingle_set(batch.column(2)[i].as_py() or "", config.words, codes)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= config.percent * (len(own) + len(other) - common) > 0:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    own = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return own.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _similar_pairs(rest: DataFrame, config: NearDupConfig) -> DataFrame:
    """(node, other): pairs of (node, label, text) with different labels that may be similar enough, by prefix and place.

    All shingles are ordered, the rarest first. Two sets over the threshold share a shingle among the first of either, and what
    follows it in both must hold enough others.
    """
    kind = rest.schema["node"].dataType.simpleString()

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", config.words, codes) for t in batch.column(0)]
            value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            # those that one batch has once say little about the order
            yield pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    often = rest.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(config.ordered_shingles).collect()
    keys = np.array([r["h"] for r in often], np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    keys, counts = keys[by_key], np.array([r["n"] for r in often], np.int64)[by_key]

    @released
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for node, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingle_set(text or "", config.words, codes)
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                known = np.where(keys[at] == own, counts[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                first = own[np.lexsort((own, known))][: len(own) - -(-config.percent * len(own) // 100) + 1]
                for column, x in zip(out, (first.view(np.int64), np.arange(len(first))), strict=False):
                    column.append(x)
                out[2] += [node] * len(first)
                out[3] += [label] * len(first)
                out[4] += [len(own)] * len(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(out[2], batch.schema.field(0).type), pa.array(out[3], batch.schema.field(1).type), pa.array(out[4], pa.int64())], ["h", "place", "node", "label", "n"])

    rows = rest.select("node", "label", "text").mapInArrow(prefix, f"h bigint, place bigint, node {kind}, label {kind}, n bigint")
    rows = written(rows, "prefixes")
    several = rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    rows = rows.join(several, "h")
    others = rows.select("h", F.col("place").alias("place2"), F.col("node").alias("other"), F.col("label").alias("label2"), F.col("n").alias("n2"))
    room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    enough = room * (100 + config.percent) >= config.percent * (F.col("n") + F.col("n2"))
    return rows.join(others, (rows["h"] == others["h"]) & (rows["node"] < others["other"]) & (rows["label"] != others["label2"]) & enough).select("node", "other").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach from each linked node.

    Alternates steps that hang a node's larger, then its smaller, neighbours on the smallest one until
    nothing changes; each step is written to the shared folder.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u != v").distinct(), "small-star")
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last:
            break
        last = mark
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots).groupBy("node").agg(F.min("label").alias("label"))


def link_documents(docs: DataFrame, config: NearDupConfig = NearDupConfig(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_shingles and component_id of every row of docs.

    component_id is the smallest id that confirmed links reach, the row's own included. A text that is null, empty
    or without words has no shingle and no link. Rows that share an id belong together; a row with a null id
    links to nothing and has no component. Other columns are not returned.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = written(sketches(docs, config, id_column, text_column), "sketches")
    sets = rows.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = sets.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    # what a class needs comes from the row of its smallest id
    heads = sets.join(classes.select(F.col("digest").alias("d"), "node"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("node"))).groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    heads = written(heads, "classes")
    members = heads.select(F.explode("bands").alias("key"), "node", "n")
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(members.join(shared, "key"), "buckets")
    central = members.groupBy("node").agg(F.sum("size").alias("common"))
    leaders = members.join(central, "node").groupBy("key").agg(F.min_by(F.struct("node", "n"), F.struct(-F.col("common"), F.col("node"))).alias("x")).select("key", F.col("x.node").alias("other"), F.col("x.n").alias("n2"))
    wanted = members.select("node").distinct()
    texts = docs.select(F.col(id_column).alias("node"), F.col(text_column).cast("string").alias("text")).join(wanted, "node").groupBy("node").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    sigs = heads.select("node", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        # a pair that several buckets hold is compared once; b is the one that is likelier to recur
        once = written(pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), "pairs")
        near = written(_pruned(once, sigs, config), "survivors")
        return written(_confirmed(near, texts, config), "links")

    ratio = 100 * F.least("n", "n2") >= config.percent * F.greatest("n", "n2")
    links = confirmed(members.join(leaders, "key").where("node != other").where(ratio))
    labels = written(connected_components(links), "labels")
    mixed = members.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = mixed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = mixed.join(split, "key").groupBy("node").agg(F.first("label").alias("label"))
    rest = written(rest.join(texts, "node"), "mixed")
    if not rest.isEmpty():
        more = confirmed(_similar_pairs(rest, config))
        if not more.isEmpty():
            labels = written(connected_components(links.unionByName(more)), "labels")
    merged = written(classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component"), F.col("copies").alias("n")), "merged")
    out = join_hot(sets.select("digest", "id", F.col("n").alias("size")), merged, "digest", rows.count()).select("id", F.col("size").alias("n"), "component")
    rest = rows.where("digest is null or id is null").select("id", "n", F.col("id").alias("component"))
    return out.unionByName(rest).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def deduplicate(docs: DataFrame, config: NearDupConfig = NearDupConfig(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of docs whose id is the smallest of their group, with all their columns; of rows that share an id, all stay. A row with a null id stays."""
    linked = link_documents(docs, config, id_column=id_column, text_column=text_column)
    gone = written(linked.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[id_column] == gone["_gone"], "left_anti")
