"""Language identification by unigram pieces, summed over all segmentations.

The piece vocabulary is a fixed public one. For each language the model holds a
probability for each piece, fitted by expectation-maximisation on the word counts of
the labelled documents. The likelihood of a word is the sum, by the forward algorithm,
over all its segmentations into pieces of any length; sums are rescaled on the way, so words of any length are
whole. A text gets the language under which its words are most likely.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, released, ship, written

WORD = re.compile(r"[^\W\d_]+")
#: Characters that are never in a word; taken out of a whole text at once, which leaves few tokens that aren't words.
SEPARATORS = string.punctuation + string.digits + "“”„‘’«»–—…¿¡、。，"
START = "▁"
#: Places after which the sums are rescaled. A piece's probability is over 1e-18, so that no sum leaves the range of a double before.
STRIDE = 12
#: Characters (words times the longest one's length) that are handled at once, unless one word has more.
CELLS = 60_000
#: Words kept with their values, or counted before they leave, in a task.
KEPT = 150_000
#: Counted words that are handled at once, unless they have more than BATCH_BYTES: groups of one length are large then.
TOGETHER = 50_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> list[str]:
    """All lower-case pieces, without special ones, of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p and p == p.lower()})


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _mixed(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that have one character more."""
    with np.errstate(over="ignore"):
        out = (hashes + codes + np.uint64(1)) * _MULTIPLIER
    return out ^ (out >> np.uint64(29))


def tokens_of(text: str | None) -> list[str]:
    """What white space and SEPARATORS part, in lower case: mostly words. No word crosses a token."""
    text = (text or "").lower()
    for c in SEPARATORS:
        text = text.replace(c, " ")
    return text.split()


def words_in(token: str) -> list[str]:
    """The words of a token: runs of letters. Numbers that aren't digits, such as fractions, are no letters."""
    if token.isalpha():
        return [token]
    return [w for run in WORD.findall(token) for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def words_of_tokens(tokens: Counter) -> dict[str, int]:
    out: dict[str, int] = {}
    for token, n in tokens.items():
        for word in words_in(token):
            out[word] = out.get(word, 0) + n
    return out


def words_of(text: str) -> dict[str, int]:
    """How often each word, a run of letters, occurs; in lower case."""
    return words_of_tokens(Counter(tokens_of(text)))


class Places(dict):
    """A number for each key, in the order in which they were first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


def groups_of(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of one length, in groups of about CELLS characters."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield from np.array_split(rows, -(-len(rows) // max(1, CELLS // int(n))))


class Lattice:
    """Pieces of many words at once. A character without a piece is one of unknown kind."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1  # the last is the unknown character
        self.longest = max(map(len, pieces), default=1)
        # for each length the first characters of pieces, by hash, with the piece that they are or -1; where the keys of each bucket start; keys of the fullest one
        self.tables = []
        for n in range(1, self.longest + 1):
            place = {p[:n]: -1 for p in pieces if len(p) > n} | {p: i for i, p in enumerate(pieces) if len(p) == n}
            codes = _codes(list(place), n)
            keys = np.zeros(len(place), np.uint64)
            for k in range(n):
                keys = _mixed(keys, codes[:, k])
            order = np.argsort(keys)
            keys, found = keys[order], np.array(list(place.values()), np.int64)[order]
            bits = np.uint64(64 - len(place).bit_length() - 2)
            each = np.bincount((keys >> bits).astype(np.int64), minlength=1 << (64 - int(bits)))
            fullest = int(each.max())
            self.tables.append((np.append(keys, [keys[-1:]] * fullest), np.append(found, [found[-1:]] * fullest), np.cumsum(each) - each, bits, fullest) if len(place) else None)

    def pieces_at(self, words: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, pieces) of all pieces of n characters in words of one length, by place: start * number of words + word. A place is followed while its characters begin a piece."""
        count, width = len(words), len(words[0])
        codes = _codes(words, width).T.ravel()
        out, places, hashes = [], np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n, table in enumerate(self.tables[:width], 1):
            inside = np.searchsorted(places, (width - n + 1) * count)
            places = places[:inside]
            found = np.full(inside, -2)
            if table and inside:
                keys, piece, first, bits, fullest = table
                hashes = _mixed(hashes[:inside], codes[places + (n - 1) * count])
                at = first[hashes >> bits]
                hit = keys[at] == hashes
                for _ in range(fullest - 1):
                    at += ~hit
                    hit |= keys[at] == hashes
                found = np.where(hit, piece[at], -2)
            if n == 1:
                out.append((1, places, np.where(found < 0, self.size - 1, found)))
            elif (whole := found >= 0).any():
                out.append((n, places[whole], found[whole]))
            on = found >= -1
            places, hashes = places[on], hashes[on]
            if not len(places):
                break
        return out

    @staticmethod
    def edges(found: list, weights: list[np.ndarray], words: int, width: int) -> list[tuple[int, int, np.ndarray | slice, np.ndarray]]:
        """(start, end, rows, weights) of what pieces_at found, by start; weights has an array for each length."""
        out = []
        for (n, places, _), weight in zip(found, weights, strict=True):
            cuts = np.searchsorted(places, np.arange(width - n + 2) * words)
            out += [(i, i + n, slice(None) if b - a == words else places[a:b] - i * words, weight[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        return sorted(out, key=lambda e: e[0])

    def sums(self, edges: list, words: int, width: int, columns: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(sum, scale): over all segmentations up to place i, the probability is sum[i] * exp(scale[i // STRIDE])."""
        alpha = np.zeros((width + 1, words, *columns))
        scale = np.zeros((width // STRIDE + 1, words, *columns))
        alpha[0] = 1
        block = 0
        for i, j, rows, weight in edges:
            if i // STRIDE > block:
                block = i // STRIDE
                ahead = alpha[block * STRIDE : block * STRIDE + self.longest]
                top = ahead.max(axis=0)
                top[top == 0] = 1
                ahead /= top
                scale[block] = scale[block - 1] + np.log(top)
            alpha[j, rows] += alpha[i, rows] * weight
        scale[block + 1 :] = scale[block]
        return alpha, scale


@dataclass
class LanguageModel:
    langs: list[str]
    pieces: list[str]
    #: Piece probabilities: a row for each piece, the last for an unknown character; a column for each language.
    probs: np.ndarray

    def word_scores(self, words: list[str], lattice: Lattice) -> np.ndarray:
        """Log likelihood of each word (with its start mark) under each language."""
        out = np.zeros((len(words), len(self.langs)))
        marked = [START + w for w in words]
        for rows in groups_of(marked):
            own = [marked[r] for r in rows]
            found = lattice.pieces_at(own)
            edges = lattice.edges(found, [self.probs[piece] for _, _, piece in found], len(own), len(own[0]))
            alpha, scale = lattice.sums(edges, len(own), len(own[0]), (len(self.langs),))
            out[rows] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1]
        return out


def word_counts(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """(lang, word, n) over whole texts, words in lower case; counted in each task before the exchange, about KEPT of them at a time."""

    def rows_of(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in counts.items():
            own = words_of_tokens(tokens)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["lang", "word", "n"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(tokens_of(text))
            if sum(map(len, counts.values())) > KEPT:
                yield from rows_of(counts)
                counts = {}
        yield from rows_of(counts)

    pairs = docs.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string"), F.col(text_column).cast("string"))
    return pairs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches, in tables of about TOGETHER rows or BATCH_BYTES."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER or sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def expected_counts(counts: DataFrame, langs: list[str], pieces: list[str], probs: np.ndarray) -> np.ndarray:
    """One step of expectation: how often each piece is used, over all segmentations of all counted words.

    What comes to the driver is at most a row for each piece and language.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, column = Lattice(pieces), pa.array(langs, pa.string())
        total = np.zeros(lattice.size * len(langs))
        for rows in together(batches):
            owner, words, weights = pc.index_in(rows.column(0), column).to_numpy().astype(np.int64), rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(float)
            marked = [START + w for w in words.tolist()]
            for group in groups_of(marked):
                own, lang = [marked[r] for r in group], owner[group]
                n, width, found = len(own), len(own[0]), lattice.pieces_at(own)
                cells = [piece * len(langs) + lang[places % n] for _, places, piece in found]
                prob = [probs.ravel()[cell] for cell in cells]
                edges = lattice.edges(found, prob, n, width)
                alpha, up = lattice.sums(edges, n, width)
                # backward: the same sums over the mirrored edges
                beta, down = lattice.sums(sorted(((width - j, width - i, at, p) for i, j, at, p in edges), key=lambda e: e[0]), n, width)
                whole = np.log(np.maximum(alpha[-1], 1e-300)) + up[-1]
                for (k, places, _), cell, p in zip(found, cells, prob, strict=True):
                    start, at = np.divmod(places, n)
                    back = width - k - start
                    share = np.exp(up[start // STRIDE, at] + down[back // STRIDE, at] - whole[at]) * weights[group][at]
                    np.add.at(total, cell, alpha[start, at] * p * beta[back, at] * share)
        cells = np.flatnonzero(total)
        piece, lang = np.divmod(cells, max(1, len(langs)))
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[cells], pa.float64())], ["piece", "lang", "n"])

    rows = counts.select("lang", "word", "n").mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((len(pieces) + 1, len(langs)))
    for r in rows:
        out[r["piece"], r["lang"]] = r["n"]
    return out


def fit(docs: DataFrame, pieces: list[str], *, text_column: str = "text", lang_column: str = "lang", rounds: int = 2, smoothing: float = 0.05) -> LanguageModel:
    """Fit piece probabilities to all rows of docs with a language.

    Rows whose language or text is null teach nothing. With no labelled row, the model has no language.
    """
    ship(docs.sparkSession)
    counts = written(word_counts(docs, text_column, lang_column), "word-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    size = len(pieces) + 1
    weight = np.array([4.0 ** -len(p) for p in pieces] + [1e-6])
    probs = np.repeat((weight / weight.sum())[:, None], len(langs), axis=1)
    for _ in range(rounds if langs else 0):
        found = expected_counts(counts, langs, pieces, probs) + smoothing
        probs = found / found.sum(axis=0)
    return LanguageModel(langs, pieces, probs.reshape(size, len(langs)))


def predict(docs: DataFrame, model: LanguageModel, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """id_column, the columns in keep, lang_pred and score (0 to 1) for every whole text.

    A null text, or one without a letter, gets `und` with score 0, as does every text if the model has
    no language. score is the posterior of the predicted language, if the text had at most 20 words with its mean evidence, so it isn't near 1 for every long text.
    """
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_column).alias("id"), *keep, F.col(text_column).cast("string").alias("_text"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, places = Lattice(model.pieces), Places()
        # of each token: the sums of its words' values, and how many they are
        values = np.zeros((0, len(model.langs) + 1))
        for batch in batches:
            langs, scores = [], []
            if len(places) > KEPT:
                places.clear()
                values = values[:0]
            texts = [np.array(list(map(places.__getitem__, tokens_of(t))), np.int64) for t in batch.column(batch.num_columns - 1).to_pylist()]
            if len(places) > len(values):
                new = [words_in(x) for x in islice(places, len(values), None)]
                owner = np.repeat(np.arange(len(new)), [len(x) for x in new])
                words = Places()
                which = [words[w] for x in new for w in x]
                found = model.word_scores(list(words), lattice)[which]
                columns = [*found.T, np.ones(len(found))]
                values = np.concatenate([values, np.column_stack([np.bincount(owner, c, minlength=len(new)) for c in columns])])
            for own in texts:
                # a text with more tokens than a task keeps is counted first, so that its values aren't copied for each of them
                *sums, n = values[own].sum(axis=0) if len(own) <= KEPT else np.bincount(own, minlength=len(values)) @ values
                if not n or not model.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                mean = np.array(sums) / n * min(20.0, n)
                best = int(np.argmax(mean))
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(mean - mean[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double").withColumnRenamed("id", id_column)
