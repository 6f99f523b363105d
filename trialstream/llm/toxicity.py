"""Toxic sentences by a subsequence string kernel and a linear support vector machine.

The kernel of two character strings counts their common subsequences of ORDER characters,
each weighted by DECAY to the power of the length that it spans in both, so inserted and
missing characters cost little. A text is a set of strings (its words in letters of any script, and runs of
single letters joined); its decision value is that of its highest-scoring string. Kernel values against a bounded set of landmark
strings, turned by the inverse square root of the landmarks' own kernel matrix (Nyström),
are the features of a support vector machine, which is trained with the witness strings
of texts with a label. The machine is linear in the weights of common subsequences, so it is kept as one number for each
subsequence of the landmarks, and a string costs the same whatever their number. Hard negatives are mined over all labelled
rows. A logistic curve gives the score; it is placed where the decision values of all labelled
rows part best, which wrong labels of texts without a witness don't move.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, ship, written

ORDER = 3
DECAY = 0.75
#: Longer strings are scored by windows of this many characters, half of which overlap.
WINDOW = 16
#: Characters that commonly stand for letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
#: Steepness of the score over the decision value, and where in the gap between the classes the score is 0.7.
CALIBRATED_SLOPE = 4.0
#: The table of subsequences is dense up to this size.
DENSE = 1 << 20
MARGIN = 0.15
_DROP = re.compile(r"[^\w\n]+|[\d_]+")
_FOREIGN, _MIXED = re.compile("[\u0370-\u052f]"), re.compile("\\S*(?:[a-z]\\S*[\u0370-\u052f]|[\u0370-\u052f]\\S*[a-z])\\S*")
#: Fixed values of Unicode: Cyrillic and Greek letters that look like Latin ones. They are read so in words that hold Latin letters too.
_ALIKE = str.maketrans("асеорхуіѕјԁкмтвнαοντρικ", "aceopxyisjdkmtbhaovtpik")
_INSIDE = re.compile(r"(?<=\w)[!|](?=\w)")


@dataclass(frozen=True)
class TrainingConfig:
    #: Labelled rows of each label that the fit reads at most, those with the lowest hash of their id.
    max_rows: int = 10_000
    #: Bounds of what the fit takes of these rows' strings: those tied to the label, random others, mined others.
    max_positive: int = 256
    #: Chance, over all strings together, that one without a tie to the label passes for tied.
    level: float = 0.01
    max_negative: int = 6000
    max_mined: int = 2000
    #: All strings tied to the label are landmarks, and clean strings: as many, or what is left of this number if that is more.
    landmarks: int = 128
    rounds: int = 2
    seed: int = 7


def normals(tokens: Iterable[str]) -> list[str]:
    """The letters of each lower-case token: without accents, look-alike characters as the letters that they stand for."""
    lines = "\n".join(tokens)
    if not lines.isascii():
        lines = unicodedata.normalize("NFKD", lines)
        if _FOREIGN.search(lines):
            lines = _MIXED.sub(lambda m: m[0].translate(_ALIKE), lines)
    return _DROP.sub("", _INSIDE.sub("i", lines).translate(LOOKALIKE)).split("\n")


def normal(token: str) -> str:
    return normals((token,))[0]


class Units(dict):
    """The string of each white-space token, kept by token; empty if it has fewer than ORDER letters."""

    LIMIT = 150_000

    def __missing__(self, token: str) -> str:
        if len(self) > self.LIMIT:
            self.clear()
        own = normal(token)
        out = self[token] = own if len(own) >= ORDER else ""
        return out


_SPACED = re.compile(r" \W?\w\W? \W?\w\W?(?= \W?\w\W? )")


def spaced(tokens: list[str]) -> set[str]:
    """Strings that runs of at least ORDER single letters give."""
    line = f" {' '.join(tokens)} "
    out = set()
    if _SPACED.search(line):
        run = ""
        for token in [*tokens, ""]:
            own = normal(token) if len(token) <= 3 else ""
            if len(own) == 1:
                run += own
            else:
                if len(run) >= ORDER:
                    out.add(run)
                run = ""
    return out


def strings(text: str, units: Units) -> set[str]:
    """The distinct strings of all sentences of text; runs of single letters are joined."""
    tokens = text.lower().split()
    out = set(map(units.__getitem__, set(tokens))) | spaced(tokens)
    out.discard("")
    return out


def windows(string: str) -> list[str]:
    if len(string) <= WINDOW:
        return [string]
    return [string[i : i + WINDOW] for i in range(0, len(string) - WINDOW // 2, WINDOW // 2)]


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.full((len(words), width), -1, np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out


def _letter_places(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The place of each code in letters (sorted); their number for a code that they lack."""
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    return np.where(letters[at] == codes, at, len(letters))


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of ORDER characters of a string, and their weights."""
    at = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


def _decay(width: int) -> np.ndarray:
    """From matches at each place to what they weigh before each later place."""
    gap = np.arange(width)[None, :] - np.arange(width)[:, None] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


def raw_kernel(words: list[str], others: np.ndarray) -> np.ndarray:
    """Kernel of each word with each row of others (codes).

    Runs over the words' characters; level i holds, before each place of the other string, the weight of common subsequences of i characters.
    """
    codes = _codes(words, max(map(len, words)))
    n, width = others.shape
    letters = np.unique(others[others >= 0])
    table = np.zeros((len(letters) + 1, n, width), np.float32)  # by letter of others, the last for any other: where it matches
    for c, letter in enumerate(letters):
        table[c] = (others == letter) * np.float32(DECAY**2)
    places = _letter_places(codes, letters)
    decay = _decay(width)
    first = table @ decay
    levels = [np.zeros((len(words), n, width), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros((len(words), n), np.float32)
    for k in range(codes.shape[1]):
        rows = np.flatnonzero(codes[:, k] >= 0)
        part = slice(rows[0], None) if len(rows) == len(words) - rows[0] else rows  # words in order of length need no copy
        c = places[part, k]
        match = table[c]
        own = [level[part] for level in levels]
        total[part] += np.einsum("nlw,nlw->nl", match, own[-1])
        for i in range(ORDER - 2, 0, -1):
            own[i] = np.float32(DECAY) * own[i] + ((match * own[i - 1]).reshape(-1, width) @ decay).reshape(match.shape)
        own[0] = np.float32(DECAY) * own[0] + first[c]
        for level, new in zip(levels, own, strict=True):
            level[part] = new
    return total


def self_kernel(words: list[str]) -> np.ndarray:
    """Kernel of each word with itself."""
    codes = _codes(words, max(map(len, words)))
    width = codes.shape[1]
    decay = _decay(width)
    levels = [np.zeros(codes.shape, np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(len(words), np.float32)
    for k in range(width):
        c = codes[:, k : k + 1]
        match = ((codes == c) & (c >= 0)) * np.float32(DECAY**2)
        total += (match * levels[-1]).sum(axis=1)
        alive = np.where(c >= 0, np.float32(DECAY), np.float32(1))
        for i in range(ORDER - 2, 0, -1):
            levels[i] = alive * levels[i] + (match * levels[i - 1]) @ decay
        levels[0] = alive * levels[0] + match @ decay
    return total


@dataclass
class ToxicityModel:
    landmarks: list[str] = field(default_factory=list)
    turn: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 0.0
    offset: float = -2.0
    #: Letters of the landmarks, sorted; keys (numbers in base of one more) and weights of the landmarks' subsequences.
    letters: np.ndarray | None = None
    keys: np.ndarray | None = None
    table: np.ndarray | None = None

    def _keys(self, words: list[str]) -> np.ndarray:
        """A number for each subsequence of each word; the words have one length."""
        places = _letter_places(_codes(words, len(words[0])), self.letters)
        at = _triples(len(words[0]))[0]
        out = places[:, at[:, 0]]
        for i in range(1, ORDER):
            out = out * (len(self.letters) + 1) + places[:, at[:, i]]
        return out

    def tabulate(self) -> None:
        """Keep the machine as one weight for each subsequence of the landmarks."""
        self.letters = np.unique(_codes(self.landmarks, max(map(len, self.landmarks))))
        self.letters = self.letters[self.letters >= 0]
        share = (self.turn @ self.weights) / np.sqrt(np.maximum(self_kernel(self.landmarks), 1e-12))
        keys = np.concatenate([self._keys([w])[0] for w in self.landmarks])
        values = np.concatenate([a * _triples(len(w))[1] for w, a in zip(self.landmarks, share, strict=True)])
        self.keys, where = np.unique(keys, return_inverse=True)
        self.table = np.bincount(where, values).astype(np.float32)
        size = (len(self.letters) + 1) ** ORDER
        if size <= DENSE:
            dense = np.zeros(size, np.float32)
            dense[self.keys] = self.table
            self.keys, self.table = None, dense

    def _raw(self, words: list[str]) -> np.ndarray:
        """Decision values without the bias, of words of one length; equal to features @ weights."""
        keys = self._keys(words)
        if self.keys is None:
            found = self.table[keys]
        else:
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = np.where(self.keys[at] == keys, self.table[at], np.float32(0))
        return found @ _triples(len(words[0]))[1] / np.sqrt(np.maximum(self_kernel(words), 1e-12))

    def features(self, words: list[str]) -> np.ndarray:
        codes = _codes(self.landmarks, max(map(len, self.landmarks)))
        own = np.sqrt(np.maximum(self_kernel(self.landmarks), 1e-12))
        out = []
        for i in range(0, len(words), 250):
            part = words[i : i + 250]
            out.append(raw_kernel(part, codes) / np.sqrt(np.maximum(self_kernel(part), 1e-12))[:, None] / own)
        return np.concatenate(out) @ self.turn

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision values of strings; the highest of a long string's windows."""
        parts = [(k, w) for k, word in enumerate(words) for w in windows(word)]
        values = np.empty(len(parts))
        lengths = np.fromiter((len(w) for _, w in parts), np.int64, len(parts))
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            for i in range(0, len(own), 1000):
                rows = own[i : i + 1000]
                values[rows] = self._raw([parts[r][1] for r in rows]) + self.bias
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, [k for k, _ in parts], values)
        return out

    def score(self, value: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * value + self.offset))))


def copy_group(text: str) -> int:
    """A number that near copies share in most cases and other texts don't: the lowest hash of three tokens in a row."""
    import xxhash

    tokens = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(" ".join(tokens[i : i + 3])) for i in range(max(1, len(tokens) - 2))), default=0) >> 1


def string_groups(docs: DataFrame, text_column: str) -> DataFrame:
    """(string, pos): in how many copy groups of docs each string occurs; the string null stands for all groups."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            out: set[tuple[str | None, int]] = set()
            for text in batch.column(0):
                own = text.as_py() or ""
                group = copy_group(own)
                out.add((None, group))
                out.update((s, group) for s in strings(own, units))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([g for _, g in out], pa.int64())], ["string", "copies"])

    found = docs.select(F.col(text_column).cast("string")).mapInArrow(run, "string string, copies bigint")
    return found.distinct().groupBy("string").agg(F.count("*").alias("pos"))


def evidence(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Minus the logarithm of a bound (Chernoff's) of the chance that pos or more of pos + neg texts are toxic if all texts are alike to a string."""
    n, p = pos + neg, n_pos / (n_pos + n_neg)
    q = pos / n
    clean = F.when(neg > 0, neg * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(q > p, pos * F.log(q / p) + clean).otherwise(0.0)


def string_counts(docs: DataFrame, text_column: str, label_column: str) -> DataFrame:
    """(string, pos, neg): in how many rows of each label each string occurs."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for s in strings(text.as_py() or "", units):
                    counts.setdefault(s, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["string", "pos", "neg"])

    own = docs.select(F.col(text_column).cast("string"), F.col(label_column).cast("int"))
    return own.mapInArrow(run, "string string, pos bigint, neg bigint").groupBy("string").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1] + penalty)
    w = v = np.zeros(z.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        new = v - step * (penalty * v - 2 * (z.T @ (weight * slack * y)))
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _obscured(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with a character inserted, doubled or left out."""
    letters, out = "abcdefghijklmnopqrstuvwxyz", []
    for word in words:
        for _ in range(4):
            i = int(rng.integers(1, len(word)))
            out += [word[:i] + letters[rng.integers(26)] + word[i:], word[:i] + word[i - 1] + word[i:]]
        if len(word) >= 6:
            i = int(rng.integers(1, len(word) - 1))
            out.append(word[:i] + word[i + 1 :])
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, config: TrainingConfig = TrainingConfig(), *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """(text, label) of rows of docs with a label of 0 or 1: all, or config.max_rows of each label.

    An id with both labels counts as toxic; null ids have no label. The chosen ids, bounded by config, are broadcast, so no text is shuffled.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    known = written(known, "labels")
    order = F.xxhash64("id"), F.col("id")
    chosen = [known.where(F.col("label") == k).orderBy(*order).limit(config.max_rows) for k in (0, 1)]
    ids = F.broadcast(written(chosen[0].unionByName(chosen[1]), "labelled-ids"))
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).join(ids, "id").select("text", "label")


def fit(docs: DataFrame, config: TrainingConfig = TrainingConfig(), *, text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Train on rows with a label of 0 or 1; others teach nothing.

    String counts, mining and calibration run over all rows of docs (labelled_sample bounds them); the strings that the solver
    takes are bounded by config. A string is tied to the label if toxic texts have it more often than chance explains, at
    config.level for all strings together; near copies of a toxic text count once. Without such a string the model gives every text the base rate.
    """
    spark = docs.sparkSession
    ship(spark)
    label = F.col(label_column).cast("int").alias("label")
    labelled = written(docs.select(F.col(text_column).cast("string").alias("text"), label).where("label in (0, 1)"), "labelled")
    toxic, clean = labelled.where("label = 1"), labelled.where("label = 0")
    counts = written(string_counts(labelled, "text", "label"), "string-counts")
    size = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    model = ToxicityModel()
    base = (n_pos + 1) / (n_pos + n_neg + 2)
    model.offset = math.log(base / (1 - base))
    groups = written(string_groups(toxic, "text"), "string-groups")
    n_groups = groups.where("string is null").agg(F.sum("pos")).first()[0] or 0
    n_texts = clean.agg(F.countDistinct(F.xxhash64("text"))).first()[0]
    if not n_groups or not n_texts:
        return model
    both = counts.drop("pos").join(groups, "string")
    share, other = (F.col("pos") + 0.5) / (n_groups + 1), (F.col("neg") + 0.5) / (n_texts + 1)
    proof = evidence(F.col("pos"), F.col("neg"), n_groups, n_texts)
    tied = both.where((proof >= math.log(max(1, counts.count()) / config.level)) & (share > 20 * other)).orderBy(proof.desc(), "string").limit(config.max_positive)
    positive = list(dict.fromkeys(w for r in tied.collect() for w in windows(r["string"])))
    if not positive:
        return model
    clear = counts.where("neg >= 1")
    negative = [r["string"] for r in clear.where(F.length("string") <= WINDOW).select("string").orderBy(F.xxhash64("string"), "string").limit(config.max_negative).collect()]
    rng = np.random.default_rng(config.seed)
    model.landmarks = list(dict.fromkeys([*positive, *negative[: max(config.landmarks - len(positive), len(positive))]]))
    gram = raw_kernel(model.landmarks, _codes(model.landmarks, max(map(len, model.landmarks))))
    own = np.sqrt(np.maximum(self_kernel(model.landmarks), 1e-12))
    values, vectors = np.linalg.eigh(gram / own[:, None] / own)
    keep = values > 1e-3
    model.turn = vectors[:, keep] / np.sqrt(values[keep])
    plain = positive + _obscured(positive, rng)
    hard: list[str] = []
    for turn in range(config.rounds):
        words = plain + negative + hard
        y = np.array([1.0] * len(plain) + [-1.0] * (len(words) - len(plain)))
        # a string that shares nothing with any landmark is clean too
        x, weight = model.features(words), np.where(y > 0, 1 / len(plain), 2 / (len(words) - len(plain)))
        model.weights, model.bias = _train_svm(np.vstack([x, np.zeros((1, x.shape[1]))]), np.append(y, -1.0), np.append(weight, 0.5))
        model.tabulate()
        if turn < config.rounds - 1:
            hard += _mine(clear, model, config.max_mined)
    return _calibrate(model, toxic, clean)


def _mine(strings_df: DataFrame, model: ToxicityModel, limit: int) -> list[str]:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                value = model.decide(words)
                near = np.flatnonzero(value > -0.9)
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in near], pa.string()), pa.array(value[near], pa.float64())], ["string", "value"])

    found = strings_df.select("string").mapInArrow(run, "string string, value double")
    return [w for r in found.orderBy(F.desc("value"), "string").limit(limit).collect() for w in windows(r["string"])]


def _calibrate(model: ToxicityModel, toxic: DataFrame, clean: DataFrame) -> ToxicityModel:
    """Place the score by the decision values of all labelled texts; near copies of a toxic text and copies of a clean one count once."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _valued(model)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([copy_group(t or "") for t in texts], pa.int64()), pa.array(values(texts), pa.float64())], ["copies", "value"])

    grouped = toxic.select("text").mapInArrow(run, "copies bigint, value double").withColumn("label", F.lit(1))
    single = decision_values(clean.select(F.xxhash64("text").alias("copies"), "text"), model, "text").withColumn("label", F.lit(0))
    both = [own.groupBy("copies", "label").agg(F.max("value").alias("value")) for own in (grouped, single)]
    bins = both[0].unionByName(both[1]).groupBy(F.round(F.greatest("value", F.lit(-5.0)) * 20).alias("value"), "label").agg(F.count("*").alias("n")).collect()
    counts: dict[float, list[int]] = {}
    for r in bins:
        counts.setdefault(r["value"] / 20, [0, 0])[r["label"]] += r["n"]
    # of the cuts that gain most true over false positives, the lowest leaves most room for disguised strings
    best, gain, cut = 0, 0, None
    for value in sorted(counts, reverse=True):
        gain += counts[value][1] - counts[value][0]
        if gain > best:
            best, cut = gain, value
    if cut is not None:
        low = max([v for v in counts if v < cut], default=cut - 1)
        model.slope = CALIBRATED_SLOPE
        model.offset = math.log(0.7 / 0.3) - model.slope * (low + MARGIN * (cut - low))
    return model


def _valued(model: ToxicityModel):
    """A function from texts to the highest decision value of a string of each, -5 at least. Its caches are bounded and end with the task."""
    known: dict[str, float] = {}

    def values(texts: list[str | None]) -> list[float]:
        if model.weights is None:
            return [0.0] * len(texts)
        out: list[float] = []
        for start in range(0, len(texts), 500):
            lists = [(t or "").lower().split() for t in texts[start : start + 500]]
            sets = [set(tokens) for tokens in lists]
            joined = [spaced(tokens) for tokens in lists]
            if len(known) > Units.LIMIT:
                known.clear()
            new = list(set().union(*sets, *joined).difference(known))
            own = normals(new) if new else []
            words = [w for w in set(own) if len(w) >= ORDER]
            by_word = dict(zip(words, model.decide(words).tolist(), strict=True)) if words else {}
            known.update(zip(new, (by_word.get(w, -5.0) for w in own), strict=True))
            out += [max(-5.0, max(map(known.__getitem__, a), default=-5.0), max(map(known.__getitem__, b), default=-5.0)) for a, b in zip(sets, joined, strict=True)]
        return out

    return values


def decision_values(docs: DataFrame, model: ToxicityModel, text_column: str) -> DataFrame:
    """docs with text_column, which comes last, replaced by value: the highest decision value of a string of the text, -5 at least."""
    others = [c for c in docs.columns if c != text_column]
    kept = docs.select(*others, F.col(text_column).cast("string"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _valued(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values(batch.column(batch.num_columns - 1).to_pylist()), pa.float64())], [*batch.schema.names[:-1], "value"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}value double")


def probability(model: ToxicityModel, value: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(model.slope) * value + F.lit(model.offset)))))


def score(docs: DataFrame, model: ToxicityModel, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[Column, ...] = (), threshold: float = 0.7) -> DataFrame:
    """id_column, the columns in keep, score (0 to 1) and predicted (1 if score reaches threshold) of every whole text.

    Null and empty texts get the score of a text without strings. Rows with equal or null ids keep their rows.
    """
    ship(docs.sparkSession)
    values = decision_values(docs.select(F.col(id_column).alias("id"), *keep, F.col(text_column).cast("string").alias("_text")), model, "_text")
    scored = values.withColumn("score", probability(model, F.col("value")))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).drop("value").withColumnRenamed("id", id_column)


def reject(docs: DataFrame, model: ToxicityModel, *, text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of docs, with all their columns, whose score is under threshold. Null and empty texts stay, unless the base rate reaches it."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_column)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _valued(model)
        for batch in batches:
            texts = (None if t is None else str(t) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([model.score(v) < threshold for v in values(list(texts))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
