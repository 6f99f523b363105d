"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merge list produces. It
starts with one state that has a loop for each byte. The gadget for merge k, (a, b) -> c,
adds an arc c wherever an arc a that can be followed by b leaves a state; gives c a
state with the arcs that b's state has at that moment; and takes b from a's state.
The arc by which a token is read always leads to that token's own state, so the state
is the last token. Gadgets are kept as three tables (where an arc was born, which
state was copied, which arc was taken away and when), since all arcs written out would be
a large part of the square of the vocabulary; a transition is read from them
once and then kept in the transition table.

Encoding reads a pre-split word once, from left to right. A prefix has one accepted token
sequence, so one state for each place is enough: at each place, the arcs that lead on from
its state set the states of the places where their labels end. The word's tokens are the arcs that led to its last state.
Decoding concatenates arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship

_WHITE = r" \t\n\x0b\x0c\r"
#: The public pattern that splits text before merging; for ASCII text, for text up to U+024F, and for any text.
ASCII_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
LATIN_SPLIT = re.compile(
    "'(?:[stmd]|re|ve|ll)| ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+"
    "| ?[^A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f0-9\u00b2\u00b3\u00b9\u00bc-\u00be \t-\r\u0085\u00a0]+"
    "|[ \t-\r\u0085\u00a0]+(?![^ \t-\r\u0085\u00a0])|[ \t-\r\u0085\u00a0]+"
)
BEYOND_LATIN = re.compile("[^\\x00-\u024f]")
ANY_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


class MergeAutomaton:
    BASE = -1

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        """tokens: id of each byte string; merges: in order of rank."""
        self.ids = tokens
        self.label = {i: b for b, i in tokens.items()}
        self.born: dict[int, tuple[int, int, int]] = {}
        self.taken: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        self.dead: set[int] = set()
        for rank, (left, right) in enumerate(merges):
            a, b, c = tokens[left], tokens[right], tokens[left + right]
            if not self._arc(a, b, rank):
                self.dead.add(c)
            self.born[c] = (a, b, rank)
            self.taken.setdefault((a, b), rank)
        #: By byte: the token that the bytes so far make up (-1 if none), and the bytes that go on.
        self.trie: dict[int, tuple[int, dict]] = {}
        for data, token in sorted(tokens.items()):
            if token not in self.dead:
                node = self.trie
                for byte in data[:-1]:
                    node = node.setdefault(byte, (-1, {}))[1]
                node[data[-1]] = (token, node.get(data[-1], (-1, {}))[1])

    def _arc(self, state: int, token: int, rank: int) -> bool:
        """Whether an arc for token leaves the state of the last token before merge number rank is applied."""
        taken, born = self.taken, self.born
        while True:
            if taken.get((state, token), rank) < rank or token in self.dead:
                return False
            _, copied, state_rank = born.get(state, (0, 0, self.BASE))
            left, right, token_rank = born.get(token, (0, 0, self.BASE))
            if state_rank == token_rank == self.BASE:
                return True
            if token_rank > state_rank:
                if state == left == right:
                    return False
                token, rank = left, token_rank
            elif state_rank > token_rank:
                state, rank = copied, state_rank
            else:
                state, token, rank = copied, left, token_rank

    def follows(self, state: int, token: int) -> bool:
        key = state << 24 | token
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 300_000:
                self.table.clear()
            known = self.table[key] = self._arc(state, token, 1 << 40)
        return known

    def encode_word(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None and whole not in self.dead:
            return [whole]  # an arc of the first state whose label is the word
        n, label, table = len(data), self.label, self.table
        state = [-1] * (n + 1)  # of each place: the token by which it is reached
        for start in range(n):
            at = state[start]
            if start and at < 0:
                continue
            node, at = self.trie, at << 24
            for end in range(start, n):
                found = node.get(data[end])
                if found is None:
                    break
                token, node = found
                if token >= 0 and state[end + 1] < 0:
                    known = True if not start else table.get(at | token)
                    if known or known is None and self.follows(state[start], token):
                        state[end + 1] = token
        path = []
        while n:
            path.append(state[n])
            n -= len(label[state[n]])
        return path[::-1]


def split(text: str) -> list[str]:
    """Words in which merges stay."""
    return (ASCII_SPLIT if text.isascii() else ANY_SPLIT if BEYOND_LATIN.search(text) else LATIN_SPLIT).findall(text)


class _Words(dict):
    """Encoded words as text of ids; emptied when it holds too many."""

    def __init__(self, automaton: MergeAutomaton, limit: int = 120_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> str:
        out = ",".join(map(str, self.automaton.encode_word(word.encode())))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


class Codec:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(vocab, merges)
        self.words = _Words(self.automaton)
        self.special = special
        self.at_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.labels = {str(i): b for b, i in vocab.items()} | {str(i): t.encode() for t, i in special.items()}

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if self.at_special is None or not self.at_special.search(text):
            return self._encode_plain(text)
        out, start = [], 0
        for hit in self.at_special.finditer(text):
            out += [self._encode_plain(text[start : hit.start()]), str(self.special[hit.group()])]
            start = hit.end()
        return ",".join(x for x in [*out, self._encode_plain(text[start:])] if x)

    def _encode_plain(self, text: str) -> str:
        return ",".join(map(self.words.__getitem__, split(text)))

    def decode_ids(self, ids: str) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids.split(","))) if ids else b""


def encode_decode(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text and decode it again.

    Returns id_column, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 and,
    if named in keep, ids (array of int) and decoded (string). A null text counts as an empty one,
    which has no tokens. Rows with equal or null ids stay as they are; other columns are not returned.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    extra = {"ids": "array<int>", "decoded": "string"}
    unknown = set(keep) - set(extra)
    if unknown:
        raise ValueError(f"keep may hold ids and decoded, not {sorted(unknown)}")
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {extra[c]}" for c in keep)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)  # half a second for a task, and no memory after it
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            coded, back = [], []
            counts, ids_digest, text_digest = [], [], []
            for text in batch.column(1):
                ids = own.encode_text(text.as_py() or "")
                data = own.decode_ids(ids)
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_digest.append(digest(ids.encode()))
                text_digest.append(digest(data))
                if "ids" in keep:
                    coded.append(np.array(ids.split(",") if ids else [], np.int32))
                if "decoded" in keep:
                    back.append(data.decode("utf-8", "replace"))
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *coded])))
            more = {"ids": lists, "decoded": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string()), *(more[c] for c in keep)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", *keep],
            )

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_column)
