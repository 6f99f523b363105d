"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a run of tokens: words, each in the context of its innermost
elements that matter, and tags. What stands in menus, headers, footers, forms and the like leaves the run.
Words in content contexts score positive, tags and words in other contexts negative; a linear
scan finds the contiguous run with the highest sum.
The weights are log odds, learnt from a bounded number of pages that label themselves
with an article or main element and smoothed by a fixed prior.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Fixed values of HTML: elements without an end tag, with raw text, and that don't break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark math mi mn mo mrow msub msup mtext picture q ruby rb rp rt s samp small source span strike strong sub sup svg time tt u var wbr".split()
)
HEAD = frozenset("head meta link title script style base noscript template basefont bgsound noframes".split())
#: Elements whose text is never content.
OUTSIDE = frozenset("nav header footer aside form button select option optgroup datalist dialog menu head template desc metadata defs object".split()) | RAW
#: Words of names in class, id or role that say the same of a block, unless the page's article lies in it.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu header masthead footer sidebar aside related recommend recommended recommendations"
    " comment comments replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social breadcrumb breadcrumbs pagination pager"
    " copyright disclaimer toolbar contentinfo complementary dialog".split()
)
#: Words of names that say what else the page has, or doesn't have, and first words of names of wrappers.
HAVING = frozenset("has have with without no not is hide show".split())
OF_WRAPPER = frozenset("js layout wrapper container".split())
#: First words that say whose block it is: the page's or the article's, not that of a part of its text.
OF_PAGE = frozenset("site page main global app top bottom home blog post entry article content body primary secondary wp web masthead".split())
#: Words that only give the place or shape of a block.
OF_SHAPE = frozenset(
    "area areas list lists box boxes wrap wrapper container section sections block blocks item items link links button buttons btn bar bars panel widget widgets inner outer content left right top bottom main primary secondary"
    " slot slots unit units form title heading thread icon icons menu nav text body group row col column wide narrow desktop mobile sticky fixed".split()
)
_ONLY_SHAPE = OF_SHAPE - OUTSIDE_WORDS
_NAME_WORDS = re.compile(r"[-_]+")
SELF_LABEL = frozenset(("article", "main"))
#: Tags between two words that cost something at most, so that empty markup doesn't cut an article in two.
LONGEST_GAP = 6
#: Words of one run apart from the labelled content that count at most, so that a long advert doesn't cut an article in two.
LONGEST_RUN = 5
_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_SPACES = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_UNQUOTED = re.compile(r"[^\s>]*")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Start tags that end an element that is still open, and the elements beyond which they don't reach.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_TABLE = frozenset("table tbody thead tfoot tr td th caption html body".split())


@dataclass(frozen=True)
class Weights:
    #: By token kind: words in content, in blocks that are mostly links, and apart from the page's own article or main element if it has one;
    #: tags of blocks, of parts of a line, and of blocks within the page's own article.
    values: dict[str, float] = field(default_factory=lambda: {"w:content": 1.0, "w:link": -0.5, "w:apart": -1.0, "t:block": -0.4, "t:inline": -0.1, "t:own": -0.05})


class _Tags:
    """Reads tags of one page. What has been looked for in vain isn't looked for again, so a page is read in one pass."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, start: int) -> int:
        if what in self.missing:
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.missing.add(what)
        return at

    def attributes(self, place: int) -> tuple[int, dict[str, str], bool]:
        """(place after the tag, attributes, whether it closes itself); the page's end if the tag doesn't end."""
        page, end, out = self.page, len(self.page), {}
        while True:
            start, place = place, _BETWEEN.match(page, place).end()
            if place >= end:
                return end, out, False
            if page[place] == ">":
                return place + 1, out, place > start and page[place - 1] == "/"
            name = _ATTRIBUTE.match(page, place)
            place, value = name.end(), ""
            after = _SPACES.match(page, place).end()
            if after < end and page[after] == "=":
                place = _SPACES.match(page, after + 1).end()
                quote = page[place : place + 1]
                close = self.find(quote, place + 1) if quote in ("'", '"') else -1
                if close >= 0:
                    value, place = page[place + 1 : close], close + 1
                else:
                    unquoted = _UNQUOTED.match(page, place)
                    value, place = unquoted[0], unquoted.end()
            out.setdefault(name[0].lower(), value)


class _Open:
    """The open elements of a page, with the last place of each name."""

    def __init__(self):
        self.stack: list[list] = []  # [name, outside, hinted]; name is empty once an inline element is closed before those in it
        self.places: dict[str, list[int]] = defaultdict(list)
        self.outside = self.hinted = 0
        self.kept: list[tuple[int, int]] = []  # (place, hinted before) of labelled elements that lie in hinted ones

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, outside: bool, hinted: bool) -> None:
        self.places[name].append(len(self.stack))
        self.stack.append([name, outside, hinted])
        self.outside += outside
        self.hinted += hinted

    def free(self) -> None:
        """The element opened last is content, whatever the names of those around it say."""
        self.kept.append((len(self.stack) - 1, self.hinted))
        self.hinted = 0

    def _gone(self, name: str, outside: bool, hinted: bool) -> None:
        self.places[name].pop()
        self.outside -= outside
        self.hinted -= hinted

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            name, outside, hinted = self.stack.pop()
            if name:
                self._gone(name, outside, hinted)
            if self.kept and self.kept[-1][0] == len(self.stack):
                self.hinted = self.kept.pop()[1]

    def close(self, name: str) -> None:
        place = self.last(name)
        if place < 0 or name not in _TABLE and place < self.last("td", "th", "caption", "table"):
            return
        if name in INLINE:
            self._gone(*self.stack[place])
            self.stack[place] = ["", False, False]
            while self.stack and not self.stack[-1][0]:
                self.stack.pop()
        else:
            self.pop_to(place)


def name_is_outside(name: str, own: bool) -> bool:
    """Whether a name in class, id or role says that its block isn't content.

    The last word says what the block is (`site-footer`), after words of place or shape (`sidebar-left`, `comments-list`). Within the page's own article or main
    element (own) the parts of a text have such names too (`section-header`, `share-price`), so there the name has to be the word alone, or the page's or the article's.
    """
    words = [w for w in _NAME_WORDS.split(name.lower()) if w]
    if not words or words[0] in OF_WRAPPER or not HAVING.isdisjoint(words):
        return False
    while len(words) > 1 and (words[-1] in _ONLY_SHAPE or words[-1].isdigit()):
        words.pop()
    if words[-1] in OUTSIDE_WORDS and (len(words) == 1 or not own or all(w in OF_PAGE or w in OUTSIDE_WORDS for w in words[:-1])):
        return True
    return not own and words[0] in OUTSIDE_WORDS


def _hint(attributes: dict[str, str], own: bool) -> bool:
    return any(len(name) < 100 and name_is_outside(name, own) for key in ("class", "id", "role") for name in attributes.get(key, "").split())


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes and attributes["hidden"].lower() != "until-found" or attributes.get("aria-hidden", "").strip().lower() == "true" or bool("style" in attributes and _NOT_SHOWN.search(attributes["style"]))


def page_tokens(page: str, names: bool = True) -> Iterator[tuple[str, str]]:
    """(kind, data) in page order. data of words is the text between tags as it stands in the page, of tags the element's name.

    Text that is never content, and the tags around it, have the kinds w:outside and t:outside; + marks what is in no article or main element.
    names: whether class, id and role count.
    """
    tags, open_ = _Tags(page), _Open()
    target = "main" if re.search(r"<main[\s>]", page, re.I) else "article"
    met = False
    own = lambda: "" if open_.places.get("article") or open_.places.get("main") else "+"
    place, end = 0, len(page)
    while place < end:
        hit = _MARKUP.search(page, place)
        stop = hit.start() if hit else end
        if stop > place:
            text = page[place:stop]
            if open_.places.get("head") and text.strip():
                open_.pop_to(open_.last("head"))
            if open_.outside or open_.hinted:
                yield "w:outside", text
            else:
                yield ("w:link" if open_.places.get("a") else "w:content") + own(), text
        if hit is None:
            return
        after = page[stop + 1]
        if after in "!?":
            mark, skip = ("-->", 4) if page.startswith("<!--", stop) else ("]]>", 9) if page.startswith("<![CDATA[", stop) else (">", 2)
            close = tags.find(mark, stop + skip)
            if close < 0 and mark == "]]>":
                mark, close = ">", tags.find(">", stop)
            place = end if close < 0 else close + len(mark)
            continue
        closing = after == "/"
        name = _NAME.match(page, stop + 1 + closing)
        if name is None:  # not a tag: a comment up to the next >
            close = tags.find(">", stop)
            place = end if close < 0 else close + 1
            continue
        place, attributes, alone = tags.attributes(name.end())
        name = name[0].lower()
        kind = "t:inline" if name in INLINE or open_.places.get("svg") or open_.places.get("math") else "t:block" + own()
        if closing:
            was = open_.outside or open_.hinted
            open_.close(name)
            yield "t:outside" if was else kind, "/" + name
            continue
        if open_.places.get("head") and name not in HEAD:
            open_.pop_to(open_.last("head"))
        if name in _P_ENDS and open_.places.get("p") and open_.last("p") > open_.last("td", "th", "table"):
            open_.pop_to(open_.last("p"))
        if name in _ENDS:
            ended, bound = _ENDS[name]
            if (at := open_.last(*ended)) > open_.last(*bound):
                open_.pop_to(at)
        outside = name in OUTSIDE or _hidden(attributes)
        hinted = names and name not in ("html", "body") and _hint(attributes, not own())
        if name in RAW:
            if name == "noscript" and alone:
                continue
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, place)
            yield "t:outside", name
            place = end if close is None else tags.attributes(close.end())[0]
            continue
        yield "t:outside" if outside or hinted or open_.outside or open_.hinted else kind, name
        if name not in VOID and not alone:
            open_.push(name, outside, hinted)
            if name == target and not met and not open_.outside and not hinted:
                met = True
                if open_.hinted:
                    open_.free()


def content_run(page: str, names: bool = True) -> list[tuple[str, str]]:
    """The tokens of the scan.

    What is never content becomes a gap. Words apart from the page's own article or main element are marked if that holds most of the words.
    Links in a block that has as many other words are content.
    """
    tokens = list(page_tokens(page, names))
    inside = apart = 0
    for kind, data in tokens:
        if kind == "w:content":
            inside += len(data.split())
        elif kind == "w:content+":
            apart += len(data.split())
    labelled = inside > apart
    out: list[tuple[str, str]] = []
    block = links = words = 0

    def end_block() -> None:
        if 0 < links <= words:
            out[block:] = [("w:content", d) if k == "w:link" else (k, d) for k, d in out[block:]]

    for kind, data in tokens:
        if kind in ("w:outside", "t:outside"):
            kind = "t:gone"
        elif kind[-1] == "+":
            kind = "w:apart" if labelled and kind[0] == "w" else kind[:-1]
        elif labelled and kind == "t:block":
            kind = "t:own"
        if kind == "w:content":
            words += len(data.split())
        elif kind == "w:link":
            links += len(data.split())
        elif kind in ("t:block", "t:own", "t:gone"):
            end_block()
            block, links, words = len(out) + 1, 0, 0
        out.append((kind, data))
    end_block()
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the highest sum; the longest of equal ones that start first; empty if none is positive."""
    best, top, total, start = (0, 0), 0.0, 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total > top or total == top > 0 and start == best[0]:
            top, best = total, (start, i + 1)
        if total <= 0:
            total, start = 0.0, i + 1
    return best


def _region_text(tokens: list[tuple[str, str]], values: dict[str, float]) -> str:
    scores, gap = [], 0
    for kind, data in tokens:
        if kind == "t:gone":
            scores.append(0.0)
            continue
        tag = kind[0] == "t"
        n = 1 if tag else len(data.split())
        gap = gap + 1 if tag else gap if n == 0 else 0
        scores.append(0.0 if tag and gap > LONGEST_GAP else values[kind] * (min(n, LONGEST_RUN) if kind == "w:apart" else n))
    start, end = best_region(scores)
    parts: list[str] = []
    for kind, data in tokens[start:end]:
        if kind in ("w:content", "w:link"):
            parts.append(entities.unescape(data) if "&" in data else data)
        elif kind != "t:inline" and kind[0] == "t":
            parts.append(" ")
    return " ".join("".join(parts).split())


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best region, in page order, joined by a space; empty if no word scores positive.

    Where class, id and role would leave no text at all, they don't count.
    """
    text = _region_text(content_run(page), weights.values)
    return text or _region_text(content_run(page, names=False), weights.values)


def learn_weights(pages: DataFrame, *, html_column: str = "html", max_pages: int = 500, prior: float = 200.0) -> Weights:
    """Log odds of each token kind inside and outside of a page's own article or main element.

    max_pages bounds the labelled pages read, chosen by a hash of their text; the prior keeps a kind that they lack
    at its usual weight. Null and empty pages, and those without such an element, teach nothing; without a labelled page the usual weights stay.
    """
    ship(pages.sparkSession)
    usual = Weights().values
    page = F.col(html_column).cast("string")
    labelled = pages.where(page.rlike("(?i)<(article|main)[ >]")).select(F.xxhash64(page).alias("h"), page.alias("page"))
    chosen = labelled.orderBy("h").limit(max_pages).select("page")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0).to_pylist():
                depth = 0
                for kind, data in page_tokens(page):
                    if kind in ("w:outside", "t:outside"):
                        continue
                    tag = kind[0] == "t"
                    depth += tag and data in SELF_LABEL
                    counts[kind.rstrip("+"), depth > 0] += 1 if tag else len(data.split())
                    depth -= tag and depth > 0 and data[:1] == "/" and data[1:] in SELF_LABEL
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([i for _, i in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], ["kind", "inside", "n"])

    inside, outside = Counter(), Counter()
    for r in chosen.mapInArrow(count, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect():
        (inside if r["inside"] else outside)[r["kind"]] += r["n"]
    if not inside:
        return Weights()
    total_in, total_out = sum(inside.values()), sum(outside.values())
    values = dict(usual)
    for kind in ("w:content", "w:link", "t:block", "t:inline"):
        n = inside[kind] + outside[kind]
        odds = math.log((inside[kind] + 0.5) / (total_in + 1) / ((outside[kind] + 0.5) / (total_out + 1)))
        value = (prior * usual[kind] + n * max(-3.0, min(3.0, odds))) / (prior + n)
        # content words stay above zero and the rest below, as the method has it; a tag costs no more than usual, since labelled regions are themselves cut at tags
        values[kind] = max(0.2, value) if kind == "w:content" else min(-0.05, value)
        if kind[0] == "t":
            values[kind] = max(values[kind], usual[kind])
    return Weights(values)


def extract(pages: DataFrame, weights: Weights, *, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep (other than text and n_chars, which are replaced), text and n_chars for every page. Pages are read whole.

    A null, empty or wordless page has an empty text; repeated rows stay.
    """
    ship(pages.sparkSession)
    kept = pages.select(*(c for c in keep if c not in ("text", "n_chars")), F.col(html_column).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}text string, n_chars bigint")
