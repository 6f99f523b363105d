"""Document fingerprints by I-Match over several randomised lexicons, with DataFrame functions only.

A term is a word, kept as its hash of 64 bits. The lexicon holds the terms whose inverse document
frequency, counted by word, lies in a band. Each randomised lexicon is a subset of it, of one of several sizes;
a text's value under it is the hash of its distinct terms there, sorted. The fingerprint is the
row of these values; that of a text without a term in any of them comes from the hash of the whole text. The likeness of
two texts is the share of equal values among the lexicons in which either has a term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, written

#: The lexicon is dealt to 2 ** BUCKET_BITS buckets by the low bits of its terms.
BUCKET_BITS = 16


@dataclass(frozen=True)
class LexiconConfig:
    #: Band of log2(rows / document frequency). Terms that only one text has are outside of any band.
    low: float = 2.0
    high: float = 14.0
    min_documents: int = 2
    #: The randomised lexicons form a tree: how many parts, of four, of each lexicon are lexicons of the next level. So
    #: they hold a quarter, a sixteenth and so on of the lexicon's terms; a text is only searched for the parts of what its parent has.
    branches: tuple[int, ...] = (3, 2, 2, 1, 1)


def words(text: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def term(word: Column) -> Column:
    return F.xxhash64(word)


def _bucket(t: Column) -> Column:
    return t.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def lexicon(docs: DataFrame, text_column: str, config: LexiconConfig = LexiconConfig()) -> DataFrame:
    """One row with buckets, an array of 2 ** BUCKET_BITS arrays: element b + 1 has the terms of the lexicon whose low bits are b.

    Document frequencies are counted by word over all rows; null texts have no term. A word of the lexicon is in rows / 2 ** high
    texts at least, so it has 2 ** high times the mean number of distinct words of a text at most, however many rows there are.
    """
    counts = docs.select(F.explode(words(F.coalesce(F.col(text_column).cast("string"), F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    rows = docs.agg(F.count("*").alias("rows"))
    idf = F.log2(F.col("rows") / F.col("df"))
    chosen = counts.join(F.broadcast(rows)).where((F.col("df") >= config.min_documents) & idf.between(config.low, config.high)).select(term(F.col("w")).alias("t"))
    parts = chosen.groupBy(_bucket(F.col("t")).alias("b")).agg(F.collect_set("t").alias("own"))
    every = docs.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").alias("b"))
    full = every.join(parts, "b", "left").select(F.struct("b", F.coalesce("own", F.array().cast("array<bigint>")).alias("own")).alias("x"))
    return full.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["own"]).alias("buckets"))


def _inside(buckets: Column):
    return lambda t: F.array_contains(F.element_at(buckets, _bucket(t).cast("int") + 1), t)


def _part(level: int, k: int):
    return lambda m: F.shiftrightunsigned(m, 2 * level).bitwiseAND(F.lit(3)) == k


def with_values(df: DataFrame, text: Column, name: str, buckets: DataFrame, config: LexiconConfig = LexiconConfig()) -> DataFrame:
    """df with name: the text's value under each randomised lexicon, 0 where it has no term there. buckets: the lexicon, a scalar subquery here, so that no row carries it.

    Without a term in any lexicon, the values are hashes of the text. df has no column that starts with an underscore, but those of with_next.
    """
    kept = df.columns
    out = df.select("*", F.xxhash64(text).alias("_text"), F.transform(words(text), term).alias("_words"), buckets.scalar().alias("_lexicon"))
    out = out.select(*kept, "_text", F.filter("_words", _inside(F.col("_lexicon"))).alias("_terms"))
    # one hash of each term decides its lexicons; sorted, so that equal sets have equal values
    out = out.withColumn("_0", F.sort_array(F.transform("_terms", lambda t: F.xxhash64(t)))).drop("_terms")
    level, last, lexicons = 0, ["_0"], []
    for level, n in enumerate(config.branches):
        parts = {f"{parent}{k}": F.filter(parent, _part(level, k)) for parent in last for k in range(n)}
        out = out.withColumns(parts)
        last = list(parts)
        lexicons += last
    values = [F.when(F.size(c) > 0, F.xxhash64(c, F.lit(i)).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint")) for i, c in enumerate(lexicons)]
    none = F.array(*[F.xxhash64(F.col("_text"), F.lit(i)).bitwiseOR(F.lit(1)) for i in range(len(lexicons))])
    return out.withColumn("_values", F.array(*values)).select(*kept, F.when(F.exists("_values", lambda v: v != 0), F.col("_values")).otherwise(none).alias(name))


def as_text(own: Column) -> Column:
    """The upper half of each value as eight hex digits, one after the other."""
    return F.array_join(F.transform(own, lambda v: F.lpad(F.hex(F.shiftrightunsigned(v, 32)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal values among those that aren't 0 in both; 1 for equal rows, 0 if there is none otherwise."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    some = F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0))
    same = F.filter(some, lambda p: p["a"] == p["b"])
    return F.when(a == b, F.lit(1.0)).when(F.size(some) == 0, F.lit(0.0)).otherwise(F.size(same) / F.size(some))


def with_next(docs: DataFrame, order_column: str, columns: list[str], derive=lambda df: df) -> DataFrame:
    """derive(docs) with next_<c> for each of columns: its value in the next row by descending order_column, after the last that of the first.

    Nulls come last; ties follow the other columns of docs. Rows are dealt to ranges of order_column; each range also gets
    the first row of the range below, so that no range is read by two tasks and no task reads all rows. Values of types other than
    numbers are dealt by their first six bytes; null ids share one range. derive adds columns to rows.
    """
    spark = docs.sparkSession
    n = docs.count()
    if not n:
        rows = derive(docs)
        return rows.select("*", *[rows[c].alias(f"next_{c}") for c in columns])
    ranges = min(10_000, max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000))
    order = F.coalesce(_as_number(docs, order_column), F.lit(float("-inf")))
    edges = sorted({e for e in docs.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0]})
    kept = docs.withColumn("_range", F.coalesce(F.call_function("array_size", F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= order)), F.lit(0)) if len(edges) < 32 else _range_of(order, edges)).withColumn("_copy", F.lit(0))
    key = [F.col(order_column).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in docs.columns if c != order_column]]
    heads = kept.groupBy("_range").agg(F.max(F.struct(order.alias("o"))).alias("top")).select("_range", F.col("top.o").alias("_top"))
    heads = written(heads, "heads")
    first = kept.join(F.broadcast(heads), "_range").where(order == F.col("_top")).drop("_top")
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*key))).where("_k = 1").drop("_k")
    above = heads.select(F.col("_range").alias("_own"), F.coalesce(F.lead("_range").over(Window.orderBy("_range")), F.first("_range").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    guests = first.join(F.broadcast(above), F.col("_range") == F.col("_own")).withColumn("_range", F.col("_to")).drop("_own", "_to").withColumn("_copy", F.lit(1)).select(*kept.columns)
    window = Window.partitionBy("_range").orderBy("_copy", *key)
    both = derive(kept.unionByName(guests))
    return both.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).where("_copy = 0").drop("_range", "_copy")


def _as_number(docs: DataFrame, column: str) -> Column:
    """A number for each value that doesn't part with the values' order."""
    if isinstance(docs.schema[column].dataType, T.NumericType):
        return F.col(column).cast("double")
    first = F.rpad(F.hex(F.substring(F.col(column).cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.conv(first, 16, 10).cast("double")


def _range_of(order: Column, edges: list[float]) -> Column:
    """How many edges are at most order, by halving."""
    if not edges:
        return F.lit(0)
    array = F.lit(edges)
    low, high = F.lit(0), F.lit(len(edges))
    state = F.struct(low.alias("a"), high.alias("b"))
    steps = max(1, len(edges).bit_length())

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["a"] + s["b"]) / 2).cast("int")
        right = F.element_at(array, F.least(middle, F.lit(len(edges) - 1)) + 1) <= order
        open_ = s["a"] < s["b"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(s["a"]).alias("a"), F.when(open_ & ~right, middle).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), state, halve)["a"]


def fingerprint(docs: DataFrame, config: LexiconConfig = LexiconConfig(), *, text_column: str = "text") -> DataFrame:
    """docs with values (array of long) and fingerprint (string) of every whole text; null counts as empty.

    Columns of docs with these two names are replaced; repeated rows stay and have equal values.
    """
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    buckets = written(lexicon(docs, text_column, config), "lexicon")
    kept = [c for c in docs.columns if c not in ("values", "fingerprint")]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), text.alias("own_text"))
    out = with_values(rows, F.col("own_text"), "values", buckets, config)
    return out.select("row.*", "values", as_text(F.col("values")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, config: LexiconConfig = LexiconConfig(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text, of the next one by descending id, and of its edited text: the last half of its characters
    replaced by as many of the next text's first ones, or all it has. Returns id_column, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. With one row, the next text is its own.
    """
    shared_dir(docs.sparkSession)
    own = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    buckets = written(lexicon(own, "text", config), "lexicon")
    pairs = with_next(own, "id", ["text", "own"], lambda df: with_values(df, F.col("text"), "own", buckets, config))
    half = F.expr("cast(floor(length(text) / 2) as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.withColumn("edited", edited).withColumns({"n_chars": F.length("text").cast("bigint"), "edited_sha256": F.sha2("edited", 256)}).drop("text", "next_text")
    pairs = with_values(pairs, F.col("edited"), "changed", buckets, config)
    return pairs.select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
