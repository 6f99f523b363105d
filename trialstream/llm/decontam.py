"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of tokens of which a fixed mask ignores some places, so that a
substituted token in an ignored place doesn't change its hash. Hashes of the benchmark's
windows are joined with those of the windows of every text; of these, a bit table of the benchmark's hashes, of fixed size,
leaves out nearly all that match nothing before the join. For each text and item with equal hashes, the two are aligned
without gaps at each of them and the overlap is grown while enough tokens agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship, written

TOKEN = re.compile(r"\w+")
#: Masks over token windows: 1 is read, 0 ignored.
MASKS = ("11111111", "1101011011", "1011101101", "110010110101", "111000111011")


@dataclass(frozen=True)
class SeedConfig:
    masks: tuple[str, ...] = MASKS
    #: Tokens that an overlap spans at least, or all tokens of a shorter item.
    min_tokens: int = 13
    #: Share of agreeing tokens in the whole overlap, and in each run of check_tokens within it.
    min_agreement: float = 0.75
    check_tokens: int = 10
    #: Each mask's bit table has 2 ** table_bits bits.
    table_bits: int = 22
    #: Seeds of the benchmark that are broadcast at most; more are joined by a shuffle.
    broadcast_seeds: int = 500_000
    #: Texts are exchanged if a hit's key has the same first key_bits bits; at most 2 ** key_bits numbers are broadcast.
    key_bits: int = 21


def token_codes(text: str, known: dict[str, int]) -> np.ndarray:
    """A 64-bit code for each token of text in lower case; known keeps codes by token."""
    import xxhash

    tokens = TOKEN.findall(text.lower())
    try:
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    except KeyError:
        if len(known) > 150_000:
            known.clear()
        for token in tokens:
            if token not in known:
                known[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the tokens that mask reads, for each place where it fits: a sum of their codes, each times an odd number of its place."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k, read in enumerate(mask):
            if read == "1":
                h += codes[k : k + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)
    return h


def grow(a: np.ndarray, b: np.ndarray, start: int, end: int, config: SeedConfig) -> tuple[int, int, int]:
    """(start, end, agreeing tokens) of the overlap of two aligned code arrays around the seed at start to end."""
    same = a == b
    for step in (1, -1):
        edge, misses = (end, []) if step == 1 else (start - 1, [])
        while 0 <= edge < len(same):
            misses = [*misses, not same[edge]][-config.check_tokens :]
            if sum(misses) > (1 - config.min_agreement) * config.check_tokens:
                break
            edge += step
        if step == 1:
            end = edge
            while end > start and not same[end - 1]:
                end -= 1
        else:
            start = edge + 1
            while start < end and not same[start]:
                start += 1
    return start, end, int(same[start:end].sum())


def _masks(config: SeedConfig) -> list[str]:
    """The masks, and those of items that are shorter than all of them: they are compared whole."""
    return [*config.masks, *("1" * n for n in range(1, min(map(len, config.masks))))]


def _item_seeds(items: DataFrame, masks: list[str], config: SeedConfig) -> DataFrame:
    """(mask, h, key, q): the seeds of (key, text) of the benchmark and their places."""
    least = min(map(len, config.masks))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = token_codes(text.as_py(), known)
                for m, mask in enumerate(masks):
                    if len(mask) < least and len(codes) != len(mask):
                        continue
                    h = seed_hashes(codes, mask).view(np.int64)
                    for column, x in zip(out, (np.full(len(h), m), h, np.full(len(h), key), np.arange(len(h))), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["mask", "h", "item_key", "q"])

    return items.select("item_key", "text").mapInArrow(run, "mask bigint, h bigint, item_key bigint, q bigint")


def _text_seeds(texts: DataFrame, masks: list[str], tables: dict[int, np.ndarray], config: SeedConfig) -> DataFrame:
    """(key, key2, mask, h, p): the seeds of (key, key2, text) that the bit tables leave. Many texts are hashed at once."""
    shift = np.uint64(64 - config.table_bits)

    def search(keys: list[tuple], texts: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        joined = np.concatenate([np.zeros(0, np.uint64), *texts])
        out: list[list] = [[] for _ in range(4)]
        for m, mask in enumerate(masks):
            if m not in tables:
                continue
            h = seed_hashes(joined, mask)
            bits = h >> shift
            near = np.flatnonzero(tables[m][(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1)
            doc = np.searchsorted(ends, near, "right")
            whole = near + len(mask) <= ends[doc]
            near, doc = near[whole], doc[whole]
            starts = ends - [len(t) for t in texts]
            for column, x in zip(out, (doc, np.full(len(near), m), h[near].view(np.int64), near - starts[doc]), strict=True):
                column.append(x)
        doc, *rest = (np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in out)
        own = np.array(keys, np.int64).reshape(-1, 2)[doc]
        return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), *map(pa.array, rest)], ["key", "key2", "mask", "h", "p"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            keys: list[tuple] = []
            texts: list[np.ndarray] = []
            held = 0
            for key, key2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys.append((key, key2))
                texts.append(token_codes(text.as_py(), known))
                held += len(texts[-1])
                if held > 300_000:
                    yield search(keys, texts)
                    keys, texts, held = [], [], 0
            if texts:
                yield search(keys, texts)

    return texts.select("key", "key2", "text").mapInArrow(run, "key bigint, key2 bigint, mask bigint, h bigint, p bigint")


def longest_overlap(codes: np.ndarray, other: np.ndarray, hits: list[tuple[str, int, int]], config: SeedConfig) -> tuple[int, ...] | None:
    """(start, end, item start, agreeing tokens, span) of the longest overlap that grows from the hits (mask, place, place in the item); None if none is long enough.

    Of equal ones, that with most agreeing tokens, then that which starts first.
    """
    # by diagonal: how many tokens differ up to each place, and the seeds grown so far. What a seed grows to depends only on
    # the runs of equal tokens that its two ends lie in, so one seed for each pair of runs stands for all.
    grown: dict[int, tuple[np.ndarray, set]] = {}
    best = None
    for mask, p, q in hits:
        shift = p - q
        a0, a1 = max(0, shift), min(len(codes), shift + len(other))
        here, there = codes[a0:a1], other[a0 - shift : a1 - shift]
        if shift not in grown:
            grown[shift] = np.cumsum(here != there), set()
        runs, seeds = grown[shift]
        seed = (int(runs[p - a0]), int(runs[p - a0 + len(mask) - 1])) if mask[0] == mask[-1] == "1" else (mask, p)
        if seed in seeds:
            continue
        seeds.add(seed)
        start, end, agree = grow(here, there, p - a0, p - a0 + len(mask), config)
        span = end - start
        if span >= min(config.min_tokens, len(other)) and agree >= config.min_agreement * span:
            row = (a0 + start, a0 + end, a0 + start - shift, agree, span)
            if best is None or (span, agree, -row[0], -row[2]) > (best[4], best[3], -best[0], -best[2]):
                best = row
    return best


def _verified(pairs: DataFrame, masks: list[str], config: SeedConfig) -> DataFrame:
    """(key, key2, item_key, start, end, item_start, agree, span) of (key, key2, item_key, hits, text, item_text) with an overlap that is long enough."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        last, codes = None, None
        for batch in batches:
            rows = []
            for key, key2, item, hits, text, item_text in zip(*(batch.column(i) for i in range(6)), strict=True):
                own = key.as_py(), key2.as_py()
                if own != last:
                    last, codes = own, token_codes(text.as_py(), known)
                found = longest_overlap(codes, token_codes(item_text.as_py(), known), [(masks[h["mask"]], h["p"], h["q"]) for h in hits.as_py()], config)
                if found:
                    rows.append((*own, item.as_py(), *found))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "key2", "item_key", "start", "end", "item_start", "agree", "span"])

    return pairs.select("key", "key2", "item_key", "hits", "text", "item_text").mapInArrow(run, "key bigint, key2 bigint, item_key bigint, start int, end int, item_start int, agree int, span int")


def _near_texts(texts: DataFrame, hits: DataFrame, config: SeedConfig) -> DataFrame:
    """(key, key2, text) of texts whose keys begin like that of a hit, found where they are read, so that other texts enter no exchange."""
    begin = F.shiftrightunsigned("key", 64 - config.key_bits)
    some = hits.select(begin.alias("begin")).distinct()
    return texts.select("key", "key2", "text", begin.alias("begin")).join(F.broadcast(some), "begin", "left_semi").drop("begin")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs as a struct row, with two hashes of the id and the text: rows with equal ones share their marks."""
    own = [docs[id_column].cast("string"), docs[text_column].cast("string")]
    row = F.struct(*[docs[c] for c in docs.columns])
    return docs.select(row.alias("row"), docs[text_column].cast("string").alias("text"), F.xxhash64(*own).alias("key"), F.xxhash64(F.lit(1), *own).alias("key2"))


def _overlaps(keyed: DataFrame, items: DataFrame, config: SeedConfig, item_column: str, item_text_column: str) -> DataFrame:
    """(key, key2, item, start, end, item_start, agree, span): the longest verified overlap of each text and item."""
    spark = keyed.sparkSession
    ship(spark)
    own = items.select(items[item_column].alias("item"), items[item_text_column].cast("string").alias("text")).where("text != ''").withColumn("item_key", F.xxhash64(F.col("item").cast("string"), "text"))
    own = written(own.dropDuplicates(["item_key"]), "items")
    masks = _masks(config)
    seeds = written(_item_seeds(own, masks, config), "item-seeds")
    # at most 2 ** table_bits numbers for each mask, however large the benchmark is, and each as one bit
    found = seeds.select("mask", F.shiftrightunsigned("h", 64 - config.table_bits).alias("b")).distinct().toPandas()
    tables: dict[int, np.ndarray] = {}
    for m, own_bits in found.groupby("mask")["b"]:
        bits = np.zeros(1 << config.table_bits, bool)
        bits[own_bits.to_numpy(np.int64)] = True
        tables[int(m)] = np.packbits(bits, bitorder="little")
    texts = keyed.where("text != ''")
    if seeds.count() <= config.broadcast_seeds:
        seeds = F.broadcast(seeds)
    hits = _text_seeds(texts, masks, tables, config).join(seeds, ["mask", "h"])
    hits = written(hits.groupBy("key", "key2", "item_key").agg(F.sort_array(F.collect_set(F.struct("mask", "p", "q"))).alias("hits")), "hits")
    wanted = hits.select("key", "key2").distinct()
    one = _near_texts(texts, hits, config).join(wanted, ["key", "key2"], "left_semi").groupBy("key", "key2").agg(F.first("text").alias("text"))
    pairs = hits.join(one, ["key", "key2"]).join(own.select("item_key", F.col("text").alias("item_text")), "item_key")
    return _verified(pairs, masks, config).join(own.select("item_key", "item"), "item_key").drop("item_key")


def find_overlaps(docs: DataFrame, items: DataFrame, config: SeedConfig = SeedConfig(), *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(doc, item, start, end, item_start, agree, span) for every verified overlap, in tokens; the longest for each row of docs and item.

    Null or empty texts and items have no overlap. Items shorter than every mask are compared whole. Repeated rows of docs repeat here, with null ids too.
    """
    keyed = _keyed(docs, id_column, text_column)
    found = written(_overlaps(keyed, items, config, item_column, item_text_column), "overlaps")
    return keyed.select(F.col("row")[id_column].alias("doc"), "key", "key2").join(found, ["key", "key2"]).drop("key", "key2")


def contamination(docs: DataFrame, items: DataFrame, config: SeedConfig = SeedConfig(), *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id_column, contaminated, n_items, longest (tokens), item_ids (sorted).

    Rows whose ids repeat or are null are judged by their own text. Null and empty texts are clean; without items, all are.
    """
    keyed = _keyed(docs, id_column, text_column)
    found = written(_overlaps(keyed, items, config, item_column, item_text_column), "overlaps")
    marks = found.groupBy("key", "key2").agg(F.count("*").alias("n_items"), F.max("span").alias("longest"), F.sort_array(F.collect_set("item")).alias("item_ids"))
    empty = F.array().cast(marks.schema["item_ids"].dataType)
    return keyed.select(F.col("row")[id_column].alias(id_column), "key", "key2").join(marks, ["key", "key2"], "left").select(
        id_column, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("item_ids", empty).alias("item_ids")
    )


def clean(docs: DataFrame, items: DataFrame, config: SeedConfig = SeedConfig(), *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Rows of docs without a verified overlap, with all their columns; rows with null ids too are judged by their own text, and null texts stay."""
    keyed = _keyed(docs, id_column, text_column)
    found = written(_overlaps(keyed, items, config, item_column, item_text_column).select("key", "key2").distinct(), "overlaps")
    return keyed.join(found, ["key", "key2"], "left_anti").select("row.*")
