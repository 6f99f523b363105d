"""The text operators against brute force, round trips and held-out rows; nulls, empty and repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import io
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialstream.llm import bpe, decontam, html_mss, imatch, langid, near_dup, suffix_dedup, toxicity, url_rank, warc_zst
from trialstream.llm.common import tokenizer_path

DOCS = "doc_id bigint, text string, id string, node string, row string, key bigint, spans int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "é漢🙂", "word " * 3000]


# --- 1 -------------------------------------------------------------------------------------------

PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class='ad'>buy this now please</div><article><h1>Head &amp; line</h1><p><b>One  two</b>\nthree<br><p>four <i>fi</i>ve</p><div class='comments'><p>first comment</p></div></article><footer>&copy; foot</footer></body></html>"


def test_html_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<nav>only menu</nav>", "t"), (5, "u", "plain words here", "t"), (5, "u", "plain words here", "t"), (6, "u", "<p>unclosed <b>tag", "t")], "page_id bigint, url string, html string, extra string")
    out = html_mss.extract(pages, html_mss.learn_weights(pages)).collect()
    got = defaultdict(list)
    for r in out:
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == ["Head & line One two three four five"]
    assert got[2] == got[3] == got[4] == [""] and got[5] == ["plain words here"] * 2 and got[6] == ["unclosed tag"]
    assert html_mss.extract(pages.limit(0), html_mss.Weights()).count() == 0


def test_line_break_between_inline_elements():
    assert html_mss.main_text("<p><b>foo</b>\n<i>bar</i></p>\n<p>b<i>a</i>z</p>", html_mss.Weights()) == "foo bar baz"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div style="overflow:hidden"><article><p>all of the text</p></article></div>', "all of the text"),
        ('<p>see <a href="/hidden-falls">the falls</a> now</p>', "see the falls now"),
        ('<div class="layout has-sidebar"><article><p>the text</p></article></div>', "the text"),
        ('<div class="elementor widget"><article><p>the text</p></article></div>', "the text"),
        ("<html><head><title>x</title><meta charset=a><body><p>the body text</p></body>", "the body text"),
        ("<article><p>before</p><svg/><p>after it</p></article>", "before after it"),
        ("<article><p>before</p><svg><title>icon</title><path/></svg><p>after it</p></article>", "before after it"),
        ("<main><p>" + "one two three " * 9 + "</p><nav>" + "<a href=x>link</a> " * 20 + "</nav><p>" + "six seven " * 9 + "</p></main>", ("one two three " * 9 + "six seven " * 9).strip()),
        ("<p>main</p><p>article</p>", "main article"),
        ('<article><p>good text of the page</p><div class="comments"><article class="comment"><p>bad comment</p></article></div></article>', "good text of the page"),
        ("<div class=sidebar><p>other things</p></div><article><p>the text here</p></article>", "the text here"),
        ("<section id=discussion><p>We discuss results.</p></section>", "We discuss results."),
        ("<article><p>teaser</p></article><div><p>the long text of this page is here, in a block of its own</p></div>", "the long text of this page is here, in a block of its own"),
        ("<ul><li>a one<li>b two</ul>", "a one b two"),
        ("<figure><img src=x><figcaption>a caption</figcaption></figure><p>text here</p>", "a caption text here"),
        ('<p title="a>b">kept text</p>', "kept text"),
        ("<p>a <b><i>x</b> y</i> z", "a x y z"),
        ("a < b and c > d &lt;i&gt;", "a < b and c > d <i>"),
        ("<p>x</p><a href='", "x"),
    ],
)
def test_main_text_of_common_markup(page, text):
    assert html_mss.main_text(page, html_mss.Weights()) == text


def test_long_malformed_pages_take_one_pass():
    for page in ("<a " * 350_000, '<a href="' * 100_000, "<" * 10**6, "<b>" * 50_000 + "<div>" * 50_000 + "</b>" * 50_000, "<![CDATA[" * 100_000):
        began = time.process_time()
        html_mss.main_text(page, html_mss.Weights())
        assert time.process_time() - began < 10


def test_html_extra_columns_and_long_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 100_000, "t", 5), (None, None, None, None, None)], "page_id bigint, url string, html string, text string, n_chars int")
    out = html_mss.extract(pages, html_mss.learn_weights(pages.limit(0)), keep=("page_id", "text", "n_chars")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in out) == [(0, 0), (1, 499_999)]


def test_best_region_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(-4, 5) for _ in range(rng.randrange(0, 12))]
        a, b = html_mss.best_region([float(x) for x in s])
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


# --- 2 -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ b\r\n", "same"), (1, None, "same"), (2, "u", None), (7, "u", ""), (None, "u", "same"), (9, "u", "é" * 5000), (9, "u", "é" * 5000), (None, "u", "lonely")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    out = warc_zst.archive_round_trip(pages, warc_zst.ArchiveConfig(archive_bytes=200)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = {i: (h or "") for i, _, h in rows if i is not None}.get(r["page_id"])
        if text is not None:
            data = text.encode()
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == warc_zst.digest32(data)
    kinds = sorted(((r["page_id"] is None, r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in out)
    assert [(k[1], k[2]) for k in kinds if k[0] == (False, 1)] == [("response", None)]
    assert [(k[1], k[2]) for k in kinds if k[0] == (False, 3)] == [("revisit", 1)]
    assert [(k[1], k[2]) for k in kinds if k[0] == (False, 7)] == [("revisit", 2)]
    assert [(k[1], k[2]) for k in kinds if k[0] == (False, 9)] == [("response", None)] * 2
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in out if r["page_id"] is None) == [("response", 0), ("revisit", 1)]
    assert warc_zst.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_reader_rejects_damage():
    sink = io.BytesIO()
    writer = warc_zst.ArchiveWriter(sink, b"some dictionary content " * 20, "n")
    writer.add(warc_zst.record("response", "1", "http://x/", b"payload", None))
    data = sink.getvalue()
    assert [h["WARC-Type"] for h, _ in warc_zst.read_archive(io.BytesIO(data))] == ["warcinfo", "response"]
    for bad in (data[:-3], b"\0" + data[1:], data[:40]):
        with pytest.raises(warc_zst.ArchiveError):
            list(warc_zst.read_archive(io.BytesIO(bad)))
    good = warc_zst.record("response", "1", "http://x/", b"payload", None)
    for wrong in (good.replace(b"WARC-Date", b"Date"), good[:-1], good + b"x", good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), b"HTTP" + good[4:]):
        with pytest.raises(warc_zst.ArchiveError):
            warc_zst.parse_record(wrong)


# --- 3 -------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(2)
    texts = [*ODD, "a<|endoftext|>b<|endoftext|>", "it's WE'LL 12²½ \x1c\x1d\x85\xa0 x", "aaaaaaa" * 40, *("".join(rng.choice("abcdeé漢 ١½'stm\n\t0-_") for _ in range(80)) for _ in range(60))]
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs_of(spark, texts), path, keep=("ids", "decoded")).collect()}
    for i, (t, w) in enumerate(zip(texts, want, strict=True)):
        r = got[i]
        assert r["ids"] == w.ids and r["n_tokens"] == len(w.ids) and r["decoded"] == (t or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, w.ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(docs_of(spark, texts).limit(0), path).count() == 0


# --- 4 -------------------------------------------------------------------------------------------

SPEECH = {"aa": "the and with this that from have was were these", "bb": "der und mit das nicht auch von sich eine werden", "cc": "le les avec dans pour une est sur plus pas"}


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(SPEECH[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    train = spark.createDataFrame([*rows, (98, "the", None), (99, None, "aa")], "doc_id bigint, text string, lang string")
    model = langid.fit(train, langid.read_pieces(tokenizer_path("piece_bpe_32k.model")))
    assert model.langs == ["aa", "bb", "cc"] and np.allclose(model.probs.sum(axis=0), 1)
    texts = ["the with that", "nicht und werden", "dans avec les", None, "", "12 !? ½²Ⅷ①", "ß" * 90]
    out = {r["doc_id"]: r for r in langid.predict(docs_of(spark, texts).select("doc_id", "text"), model).collect()}
    assert [out[i]["lang_pred"] for i in range(6)] == ["aa", "bb", "cc", "und", "und", "und"] and all(0 <= r["score"] <= 1 for r in out.values())
    empty = langid.fit(train.limit(0), ["a"])
    assert {r["lang_pred"] for r in langid.predict(train, empty).collect()} == {"und"}


def test_only_letters_make_words():
    assert langid.words_of("½ ² Ⅷ ① 12 _") == {} and langid.words_of("a½b Ab ab") == {"a": 1, "b": 1, "ab": 2}


def test_sums_of_long_words_and_pieces(spark):
    """Pieces of any length and words of any length, against sums of logarithms; one step of expectation against the same."""
    rng = np.random.default_rng(3)
    pieces = ["a", "b", "ab", "▁", "abababababab", "babababababababab"]
    lattice, probs = langid.Lattice(pieces), rng.random((7, 1)) * 1e-4
    place = {p: i for i, p in enumerate(pieces)}
    words = ["ab", "ab" * 400, "abababababab" * 30 + "c", "x" * 50]

    def sums(word):
        out = np.full(len(word) + 1, -np.inf)
        out[0] = 0
        for j in range(1, len(word) + 1):
            for n in range(1, min(17, j) + 1):
                k = place.get(word[j - n : j], 6 if n == 1 else None)
                if k is not None:
                    out[j] = np.logaddexp(out[j], out[j - n] + np.log(probs[k, 0]))
        return out

    got = langid.LanguageModel(["x"], pieces, probs).word_scores(words, lattice)[:, 0]
    assert np.allclose(got, [sums("▁" + w)[-1] for w in words])
    want = np.zeros(7)
    for w in words:
        text = "▁" + w
        up, down = sums(text), np.full(len(text) + 1, -np.inf)
        down[-1] = 0
        for i in range(len(text) - 1, -1, -1):
            for n in range(1, min(17, len(text) - i) + 1):
                k = place.get(text[i : i + n], 6 if n == 1 else None)
                if k is not None:
                    down[i] = np.logaddexp(down[i], down[i + n] + np.log(probs[k, 0]))
        for i in range(len(text)):
            for n in range(1, min(17, len(text) - i) + 1):
                k = place.get(text[i : i + n], 6 if n == 1 else None)
                if k is not None:
                    want[k] += np.exp(up[i] + np.log(probs[k, 0]) + down[i + n] - up[-1])
    counts = spark.createDataFrame([("x", w, 1) for w in words], "lang string, word string, n bigint")
    assert np.allclose(langid.expected_counts(counts, ["x"], pieces, probs)[:, 0], want)


class Captured:
    """Stands for a DataFrame and keeps the function over batches that its rows would pass."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def collect(self):
        return []

    def __getattr__(self, name):
        return lambda *_: self


def batches_of(rows, names, size):
    return (pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size))


def test_a_word_leaves_a_counting_task_once(spark):
    docs = Captured()
    langid.word_counts(docs, "text", "lang")
    rows = [("aa", "One, one two"), ("bb", "ONE"), ("aa", None), ("aa", "two…½three")] * 3
    got = [tuple(r.values()) for b in docs.run(batches_of(rows, ["lang", "text"], 2)) for r in b.to_pylist()]
    assert sorted(got) == [("aa", "one", 6), ("aa", "three", 3), ("aa", "two", 6), ("bb", "one", 3)]


def test_expectation_takes_small_batches_together(spark, monkeypatch):
    """Words of one length are summed at once, however small the batches are: once forward and once backward."""
    rng, counts, pieces = random.Random(4), Captured(), ["a", "b", "ab", "▁a", "▁"]
    probs = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.1], [0.1, 0.2], [0.2, 0.2], [1e-6, 1e-6]])
    langid.expected_counts(counts, ["x", "y"], pieces, probs)
    rows = [(rng.choice("xy"), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), rng.randrange(1, 4)) for _ in range(200)]
    calls, sums = [], langid.Lattice.sums
    monkeypatch.setattr(langid.Lattice, "sums", lambda *args: (calls.append(1), sums(*args))[1])

    def total(size):
        out = np.zeros(probs.shape)
        for batch in counts.run(batches_of(rows, ["lang", "word", "n"], size)):
            np.add.at(out, (batch.column(0).to_numpy(), batch.column(1).to_numpy()), batch.column(2).to_numpy())
        return out

    small = total(5)
    assert len(calls) == 2 * 4 and np.allclose(small, total(200)) and small.sum() > 0


def test_pieces_are_found_where_they_are():
    rng = random.Random(5)
    pieces = sorted({"".join(rng.choice("abé中") for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(60)} - {"b"})
    words = ["".join(rng.choice("abé中x") for _ in range(11)) for _ in range(50)] + ["ababababab" + c for c in "ab"]
    got = {(n, int(at), int(p)) for n, places, found in langid.Lattice(pieces).pieces_at(words) for at, p in zip(places, found, strict=True)}
    place = {p: i for i, p in enumerate(pieces)}
    want = {(n, i * len(words) + k, place.get(w[i : i + n], len(pieces))) for k, w in enumerate(words) for n in range(1, 10) for i in range(12 - n) if n == 1 or w[i : i + n] in place}
    assert got == want


def test_words_of_tokens_are_those_of_the_text(spark):
    """Separators, spaces and marks of any kind, against the expression on the whole text; a text with more tokens than a task keeps."""
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("ΣσİßÉa5½Ⅷ_.,'-­\u0307\u200b\u00a0\u2028\x1c\n «»…") for _ in range(25))
        want = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() or not c.isnumeric() else " " for c in text.lower()))
        assert langid.words_of(text) == {w: want.count(w) for w in want}
    model = langid.LanguageModel(["x", "y"], ["a", "b", "▁"], np.array([[0.6, 0.1], [0.1, 0.6], [0.2, 0.2], [0.1, 0.1]]))
    rows = langid.predict(docs_of(spark, ["a, b a " * (langid.KEPT // 2), "a b a"]), model).collect()
    assert [r["lang_pred"] for r in rows] == ["x", "x"] and rows[0]["score"] > rows[1]["score"] > 0.5


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a"]
    lattice = langid.Lattice(pieces)
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.12], [1e-6]])
    own = dict(zip(pieces, p[:, 0], strict=False))

    def total(word):
        return 1.0 if not word else sum(own[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in own)

    got = langid.LanguageModel(["x"], pieces, p).word_scores(["abab", "ba", "a"], lattice)[:, 0]
    assert np.allclose(got, [np.log(total("▁" + w)) for w in ("abab", "ba", "a")])


# --- 5 -------------------------------------------------------------------------------------------


def test_string_kernel_matches_brute_force():
    from itertools import combinations

    def kernel(s, t):
        out = 0.0
        for a in combinations(range(len(s)), toxicity.ORDER):
            for b in combinations(range(len(t)), toxicity.ORDER):
                if [s[i] for i in a] == [t[j] for j in b]:
                    out += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return out

    words = ["idiot", "idxiot", "banana", "abc", "toidi"]
    got = toxicity.raw_kernel(words, toxicity._codes(words, 6))
    assert np.allclose(got, [[kernel(s, t) for t in words] for s in words], rtol=1e-4)
    assert np.allclose(toxicity.self_kernel(words), [kernel(s, s) for s in words], rtol=1e-4)


def test_toxicity(spark):
    rng = random.Random(4)
    plain = lambda: " ".join("".join(rng.choice(["ti", "on", "ha", "er", "es", "th", "nd", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    bad = ["gremlin", "wretch", "scoundrel"]
    rows = []
    for i in range(240):
        words = plain().split()
        label = int(i % 4 == 0)
        for _ in range(3 * label):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), label))
    rows += [(900, None, 1), (901, "x", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    tests = [plain() + " gremlin", plain() + " g-r-e-m-l-i-n", plain() + " gremxlin", plain() + " w r e t c h er", plain(), plain(), None, "", "gremlin " + plain() * 50]
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, tests), model).collect()}
    assert [got[i]["predicted"] for i in range(9)] == [1, 1, 1, 1, 0, 0, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.fit(spark.createDataFrame([], "doc_id bigint, text string, toxic int"))
    assert {r["predicted"] for r in toxicity.score(docs_of(spark, tests), none).collect()} == {0}


def invented(rng, n):
    return ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(3, 5))) for _ in range(n)]


def test_toxicity_learns_many_rare_strings(spark):
    rng = random.Random(40)
    plain = lambda: " ".join("".join(rng.choice(["ti", "on", "ha", "er", "es", "th", "nd", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(25))
    bad = sorted(set(invented(rng, 44)))[:40]
    rows = [(i, plain() + (" " + bad[i // 10 % 40] if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(4000)]
    wrong = plain() + " " + " ".join("".join(rng.choice("wxjqy") for _ in range(7)) for _ in range(8))  # near copies with a wrong label count once
    rows += [(5000 + i, f"{wrong} tail{i}", 1) for i in range(30)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    tests = [plain() + " " + b + " " + plain() for b in bad] + [plain() for _ in range(40)] + [wrong.split(" ", 25)[-1]]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs_of(spark, tests), model).collect()}
    assert sum(got[i] for i in range(40)) >= 30 and sum(got[i] for i in range(40, 80)) <= 1 and got[80] == 0


def test_toxicity_table_equals_kernel():
    rng = np.random.default_rng(5)
    model = toxicity.ToxicityModel(landmarks=["idiot", "дурак", "banana"], turn=np.eye(3), weights=rng.normal(size=3), bias=0.25)
    words = ["idxiot", "дуррак", "bananas", "χαζός", "abc"]
    for dense in (1 << 20, 0):
        toxicity.DENSE, kept = dense, toxicity.DENSE
        model.tabulate()
        toxicity.DENSE = kept
        assert np.allclose(model.decide(words), model.features(words) @ model.weights + model.bias, atol=1e-5)


@pytest.mark.parametrize("letters", ["bcdfghklmnprstvz", "бвгдзклмнпрстфхц"])
def test_toxicity_separates_many_strings_of_any_script(spark, letters):
    rng = random.Random(41)
    make = lambda n: ["".join(rng.choice(letters) + rng.choice("aeiou" if letters[0] == "b" else "аеиоу") for _ in range(rng.randrange(2, 4))) for _ in range(n)]
    common = make(300)
    bad = sorted(set(make(44)) - set(common))[:40]
    plain = lambda: " ".join(rng.choice(common) for _ in range(25))
    rows = [(i, plain() + (" " + bad[i // 10 % 40] if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(4000)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    tests = [plain() + " " + b + " " + plain() for b in bad] + [plain() for _ in range(40)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs_of(spark, tests), model).collect()}
    assert sum(got[i] for i in range(40)) >= 38 and sum(got[i] for i in range(40, 80)) <= 1


# --- 6 -------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    count = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(rng, 30) for _ in range(4)]
    texts = [*ODD, "ab" * 300, "x" * 500]
    for _ in range(40):
        parts = [prose(rng, rng.randrange(1, 20)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        if rng.random() < 0.4:
            s = rng.choice(shared)
            at = rng.randrange(len(s))
            parts.append(s[at : at + rng.randrange(20, 120)])
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-2], texts[-3][:150] + "é" + texts[-3][150:]]
    config = suffix_dedup.RepeatConfig(length=60, anchor=16)
    df = docs_of(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, config, digest=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    want = brute_repeats(texts, 60)
    assert got == dict(enumerate(want))
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(df, config).select("row.doc_id", "kept").collect()}
    assert kept[0] is None and all(hashlib.sha256(bytes(kept[i])).hexdigest() == want[i][3] for i in range(1, len(texts)))
    assert suffix_dedup.remove_repeats(df.limit(0), config, digest=True).count() == 0


def test_repeated_rows_are_copies(spark):
    text = "z".join(map(str, range(200)))
    got = suffix_dedup.remove_repeats(docs_of(spark, [text, text], [7, 7]), digest=True).collect()
    assert [r["n_removed"] for r in got] == [len(text)] * 2
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(docs_of(spark, [text, "other"], [None, 1]), digest=True).collect()] == [0, 0]


def test_loser_tree_merges():
    rng = random.Random(6)
    runs = [sorted((bytes(rng.choices(b"ab", k=rng.randrange(1, 9))), 1, 1) for _ in range(rng.randrange(0, 30))) for _ in range(5)]
    out = list(suffix_dedup.LoserTree([suffix_dedup.decode_run(suffix_dedup.front_code(r)) for r in runs]))
    assert [s for _, s, _, _ in out] == sorted(s for r in runs for s, _, _ in r)
    last = b""
    for n, s, _, _ in out:
        assert n == suffix_dedup.common_prefix(last, s) or last == b""
        last = s


def test_whole_characters(spark):
    """A character that a cut divides goes whole; one that stands for a lost one stays if no cut meets it."""
    shared = "z".join(map(str, range(100)))
    texts = ["a\u00e9" + shared + "\u6f22b", "c\u0169" + shared + "\u6f23d", "lost \ufffd stays", None]  # the pairs share their last byte and their first two
    out = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs_of(spark, texts), whole_characters=True).select("row.doc_id", "kept").collect()}
    assert out[0].decode() == "ab" and out[1].decode() == "cd" and out[2].decode() == texts[2] and out[3] is None


# --- 7 -------------------------------------------------------------------------------------------


def brute_components(texts, ids, size, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dup_matches_brute_force(spark):
    rng = random.Random(7)
    base = [prose(rng, 150).split() for _ in range(3)]
    texts = [*ODD, "", "a", "A", "two words", "Two  WORDS"]
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    texts += [texts[-1], texts[-1].upper()]
    ids = random.Random(8).sample(range(1000), len(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.link_documents(docs_of(spark, texts, ids), near_dup.NearDupConfig(words=4)).collect()}
    assert got == brute_components(texts, ids, 4, 80)
    kept = near_dup.deduplicate(docs_of(spark, texts, ids), near_dup.NearDupConfig(words=4))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c) and kept.columns == docs_of(spark, ["x"]).columns
    assert near_dup.link_documents(docs_of(spark, texts, ids).limit(0)).count() == 0


def test_near_dup_null_and_repeated_ids(spark):
    got = near_dup.link_documents(docs_of(spark, ["a b c d e f", "a b c d e f", "q"], [None, 4, 4])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (4, 4), (4, 4)]


def test_pruning_bound_keeps_similar_pairs():
    for n, need in near_dup.least_matches(192, 24, 80, 1e-6):
        assert need < 0.8 * n


# --- 8 -------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.example.org/es/1?x", "https://example.org/en/12", "http://b.example.org/fr/", "http://x.com/fr/a#f", "http://x.com/de/", "http://org/", "http://x.net/en", "nothing", None, "http://notexample.orgs/", "ftp://Ü.ORG/es/"]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(urls)], "page_id bigint, url string, html string, rule string")
    got = {r["page_id"]: r for r in url_rank.judge(pages).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 3, 7, 8)] == [("a.example.org", "/es/1"), ("x.com", "/fr/a"), ("", ""), ("", "")]
    assert [got[i]["rule"] for i in range(11)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "org/", None, None, None, None, "org/"]
    assert [got[i]["verdict"] for i in range(11)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert url_rank.judge(pages.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/">l</a>' for h in hosts)
    pages = spark.createDataFrame([(1, "http://bad.com/de/", None), (2, "http://spam.net/x", link("bad.com", "bad.com")), (3, "http://good.org/", link("fine.net")), (4, "http://fine.net/", "<a href='/own'>"), (5, "http://lone.net/", None)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_rank.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_personalised_rank_matches_power_iteration(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("c", "end", 1)]
    config = url_rank.RankConfig()
    got = {r["host"]: r["rank"] for r in url_rank.personalised_rank(spark.createDataFrame(edges, "src string, dst string, n bigint"), spark.createDataFrame([("a", 1.0)], "host string, seed double"), config).collect()}
    total = defaultdict(int)
    for s, _, n in edges:
        total[s] += n
    rank = {"a": 1.0}
    for _ in range(300):
        new = defaultdict(float, {"a": 1 - config.damping})
        for s, d, n in edges:
            new[d] += config.damping * rank.get(s, 0) * n / total[s]
        new["a"] += config.damping * sum(r for h, r in rank.items() if h not in total)  # hosts without links give back to the seeds
        rank = new
    assert got == pytest.approx(dict(rank), abs=1e-5) and sum(got.values()) == pytest.approx(1)


def test_rank_reaches_along_long_paths(spark):
    """A chain of 30 hosts that ends without a link."""
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(30)], "src string, dst string, n bigint")
    got = {r["host"]: r["rank"] for r in url_rank.personalised_rank(edges, spark.createDataFrame([("h0", 1.0)], "host string, seed double")).collect()}
    power = [0.85**i for i in range(31)]
    assert got == pytest.approx({f"h{i}": p / sum(power) for i, p in enumerate(power)}, abs=1e-5)


def test_one_host_with_most_pages(spark):
    rows = [(i, "http://big.net/x", None) for i in range(500)] + [(1000 + i, f"http://h{i}.org/", None) for i in range(3)] + [(2000, "http://b.com/de/", '<a href="http://big.net/">x</a>'), (2001, "http://big.net/", '<a href="http://b.com/">y</a>')]
    got = {r["page_id"]: r["verdict"] for r in url_rank.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and got[0] == "block" and got[1001] == "allow"


# --- 9 -------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (40, 20, 15, 5)]
    swap = items[0].split()
    for k in (5, 13, 22, 31):
        swap[k] = "other"
    texts = [prose(rng, 60), prose(rng, 30) + " " + items[0].upper() + " " + prose(rng, 30), " ".join(swap), "; ".join(items[1].split()), items[3], None, "", " ".join(items[0].split()[:7]) + " " + prose(rng, 20), prose(rng, 40000) + " " + items[2]]
    bench = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id bigint, text string")
    for config in (decontam.SeedConfig(), decontam.SeedConfig(broadcast_seeds=0, table_bits=4)):
        got = {r["doc_id"]: r for r in decontam.contamination(docs_of(spark, texts), bench, config).collect()}
        assert [got[i]["contaminated"] for i in range(9)] == [False, True, True, True, True, False, False, False, True]
        assert [got[i]["item_ids"] for i in (1, 2, 3, 4, 8)] == [[0], [0], [1], [3], [2]] and got[1]["longest"] == 40
    assert sorted(r["doc_id"] for r in decontam.clean(docs_of(spark, texts), bench).collect()) == [0, 5, 6, 7]
    assert decontam.contamination(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_null_and_repeated_ids(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = docs_of(spark, [item, "fine words", item, "other", None], [None, None, 5, 5, 6])
    bench = spark.createDataFrame([(1, item), (1, item), (2, "fine"), (None, "tiny item")], "item_id bigint, text string")
    got = sorted(((r["doc_id"] or 0), r["contaminated"], r["n_items"]) for r in decontam.contamination(docs, bench).collect())
    assert got == [(0, True, 1), (0, True, 1), (5, False, 0), (5, True, 1), (6, False, 0)]
    kept = decontam.clean(docs.withColumn("doc", F.lit(1)).withColumn("key2", F.lit("x")), bench)
    assert sorted(r["text"] or "" for r in kept.collect()) == ["", "other"] and kept.columns[-2:] == ["doc", "key2"]


def test_only_texts_near_hits_are_exchanged(spark):
    texts = spark.range(2000).select(F.xxhash64("id").alias("key"), F.col("id").alias("key2"), F.lit("t").alias("text"))
    hits = texts.where("key2 % 100 = 7").select("key", "key2")
    got = {r["key2"] for r in decontam._near_texts(texts, hits, decontam.SeedConfig()).collect()}
    assert {k for k in range(2000) if k % 100 == 7} <= got and len(got) < 25
    every = decontam._near_texts(texts, hits, decontam.SeedConfig(key_bits=1))
    assert every.count() == 2000


def test_recall_under_substitutions(spark):
    """Passages of 40 tokens in which a share of the tokens, chosen at random, is replaced."""
    rng = random.Random(12)
    items = [prose(rng, 40) for _ in range(60)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    caught = {}
    for share in (0.0, 0.05, 0.1, 0.15):
        texts = [prose(rng, 50) + " " + " ".join("swap" if rng.random() < share else w for w in item.split()) + " " + prose(rng, 50) for item in items]
        caught[share] = decontam.contamination(docs_of(spark, texts), bench).where("contaminated").count() / 60
    assert caught[0.0] == caught[0.05] == 1 and caught[0.1] >= 0.98 and caught[0.15] >= 0.9


def test_overlaps_match_brute_force(spark):
    """The longest overlap of all hits of all masks, also where close misses part stretches of one diagonal."""
    rng, config = random.Random(1), decontam.SeedConfig()
    item = [f"w{i}" for i in range(40)]
    texts, want = [], []
    for _ in range(300):
        text = [w if rng.random() < 0.8 else f"x{i}" for i, w in enumerate(item)]
        known = {}
        codes = [decontam.token_codes(" ".join(t), known) for t in (text, item)]
        spans = [0]
        for m in config.masks:
            for p in range(40 - len(m) + 1):
                if all(text[p + k] == item[p + k] for k, read in enumerate(m) if read == "1"):
                    start, end, agree = decontam.grow(*codes, p, p + len(m), config)
                    if end - start >= config.min_tokens and agree >= config.min_agreement * (end - start):
                        spans.append(end - start)
        texts.append(" ".join(text))
        want.append(max(spans))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: r["longest"] for r in decontam.contamination(docs_of(spark, texts), bench, config).collect()}
    assert [got[i] for i in range(300)] == want


# --- 10 ------------------------------------------------------------------------------------------


def test_edited_texts(spark):
    rng = random.Random(10)
    texts = [*ODD, *(prose(rng, rng.randrange(1, 300)) for _ in range(40))]
    texts.append(texts[-1])
    ids = random.Random(11).sample(range(500), len(texts))
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs_of(spark, texts, ids)).collect()}
    by = dict(zip(ids, texts, strict=True))
    order = sorted(ids, reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, u = by[i] or "", by[j] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + u[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert (got[i]["near_next"] == 1) == (got[i]["fingerprint"] == got[j]["fingerprint"])
    assert got[ids[-1]]["fingerprint"] == got[ids[-2]]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])
    assert imatch.edited_fingerprints(docs_of(spark, texts).limit(0)).count() == 0
    one = imatch.edited_fingerprints(docs_of(spark, ["abcd"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_fingerprint_keeps_rows(spark):
    got = imatch.fingerprint(docs_of(spark, ["a b", "a b", None], [1, 1, None])).collect()
    assert len(got) == 3 and got[0]["fingerprint"] == got[1]["fingerprint"]


def test_texts_without_terms_differ(spark):
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs_of(spark, ["lonely", "single", "single", "", None])).collect()}
    assert got[1]["near_next"] == 0 and got[2]["near_next"] == 1 and got[4]["near_next"] == 1
    assert len({got[i]["fingerprint"] for i in range(5)}) == 3


def test_fingerprints_of_named_ids(spark):
    """Ids that are strings, in their own order, and columns with the names of results."""
    docs = spark.createDataFrame([(f"doc{i:04}", f"text {i} of many", "v", "f") for i in range(50)], "doc_id string, text string, values string, fingerprint string")
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs).collect()}
    for i in range(1, 50):
        t, u = f"text {i} of many", f"text {i - 1} of many"
        assert got[f"doc{i:04}"]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    assert imatch.fingerprint(docs).columns == ["doc_id", "text", "values", "fingerprint"]


def test_lexicon_counts_whole_words(spark):
    """Rare words stay outside and words of the band inside, also with millions of words in the corpus."""
    band = [f"band{i}" for i in range(64)]
    texts = [" ".join([*(band[(i * 7 + k) % 64] for k in range(8)), *(f"once{i}x{k}" for k in range(20000))]) for i in range(80)]
    lexicon = imatch.lexicon(docs_of(spark, texts), "text")
    of = spark.createDataFrame([(w,) for w in band + [f"once{i}x{k}" for i in range(4) for k in range(500)]], "w string")
    got = {r["w"] for r in of.crossJoin(lexicon).where(imatch._inside(F.col(lexicon.columns[0]))(imatch.term(F.col("w")))).select("w").collect()}
    assert got == set(band)


PROSE = "word " * 60
NOTE = "<p>other text of some length that is here</p>"


@pytest.mark.parametrize("name", "site-header site-footer page-footer main-nav main-menu main-navigation article-comments entry-footer content-sidebar page-sidebar article-related post-share article-newsletter site-notice sidebar-left comments-list comment-12 nav-links cookie-banner footer_links".split())
def test_blocks_that_names_say_are_outside(name):
    assert "other" not in html_mss.main_text(f'<div class="post"><p>{PROSE}</p></div><div class="{name}">{NOTE}</div>', html_mss.Weights())


@pytest.mark.parametrize("name", "section-header card-header related-work share-price ad-spend social-policy menu-engineering navigation-systems footer-note login-tutorial".split())
def test_parts_of_an_article_with_such_names_stay(name):
    assert "other" in html_mss.main_text(f'<article><p>{PROSE}</p><div class="{name}">{NOTE}</div><p>{PROSE}</p></article>', html_mss.Weights())


@pytest.mark.parametrize("name", "has-sidebar layout-sidebar-left with-menu no-header page-with-sidebar".split())
def test_wrappers_that_name_what_they_have(name):
    assert html_mss.main_text(f'<div class="{name}"><p>{PROSE}</p></div>', html_mss.Weights()) == PROSE.strip()


@pytest.mark.parametrize("gap", ["<div></div>" * 300, "<br>" * 40, "<div> </div>" * 20, "</main><p></p><main>", "</main>" + "<div></div>" * 60 + "<main>"])
def test_empty_markup_does_not_cut_an_article(gap):
    text = html_mss.main_text(f"<main><p>first {PROSE}</p>{gap}<p>last {PROSE}</p></main>", html_mss.Weights())
    assert text.startswith("first word") and "last word" in text and len(text.split()) == 122
