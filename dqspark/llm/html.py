"""Main text of web pages: the contiguous run of tokens with the highest score.

A page becomes a row of tokens: start tags, end tags, and stretches of words.  Words score
by the place they stand in, positive where labelled pages have content and negative where
they have menus or adverts; tags score negative, tokens of an aside nothing.  Weights are log odds from pages that mark
their content themselves, with ``<article>`` or ``<main>``; the marks are no features.  One
linear scan finds the best run, and its text is put out without what is no content.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, with_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose content is no text of the page, and those that hold no article text.
RAW = frozenset("script style noscript template iframe object svg canvas math head title textarea select option".split())
ASIDE = frozenset("nav header footer aside form button dialog menu fieldset label legend".split())
CONTENT = frozenset(("article", "main"))
#: Words of a class, id or role that mark an element as no content.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header login masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
KNOWN = VOID | INLINE | RAW | ASIDE | frozenset("blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 html li ol p pre section summary table tbody td tfoot th thead tr ul address".split())
#: Elements that are a part of a text, not a container of something else: inside the content element a mark on one says nothing.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li td th dt dd caption figcaption label legend".split())
#: Weights beyond this are cut off; a tag scores this at most; weights where no page is labelled.
STRONGEST, TAG = 4.0, -0.05
PLAIN = {"word": 1.0, "tag": -0.5, "aside": -2.0}

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)|([^<]++|<)""", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tokenize(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of start tags, end tags and texts; comments, declarations and raw content are left out."""
    at, size = 0, len(page)
    while at < size:
        found = TOKEN.match(page, at)
        at = found.end()
        text = found[7]
        if text is not None:
            yield "text", text, ""
            continue
        name = found[2] or found[5]
        if name is None:
            continue
        name, attributes = name.lower(), found[3] or found[6] or ""
        if found[1] or found[4]:
            yield "end", name, ""
            continue
        yield "start", name, attributes
        if name in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"):
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else size


def marked(attributes: str) -> bool:
    """Whether a class, id or role says that an element is no content."""
    return "=" in attributes and any(w in ASIDE_WORDS for groups in MARKS.findall(attributes) for g in groups for w in re.split(r"[^a-z0-9]+", g.lower()))


class Place:
    """Open elements while a page is read.

    Elements are numbered by their start tags.  ``wraps`` are those that hold the page's
    content, so a form or a mark says nothing there; ``main`` is the content element, in
    which what stands around it is no aside.
    """

    def __init__(self, wraps: frozenset[int] = frozenset(), main: int = -1):
        self.open: list[tuple[str, bool, bool, int]] = []
        self.wraps, self.main, self.number = wraps, main, -1

    def start(self, name: str, attributes: str) -> bool:
        """Whether the element, if it is opened here, holds no article text."""
        self.number += 1
        if name not in INLINE and name not in VOID:
            while self.open and (self.open[-1][0] in INLINE or self.open[-1][0] == "p" or self.open[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                self.close(len(self.open) - 1)
        part = name in PARTS and self.content
        told = name == "form" or name not in ("html", "body", *CONTENT) and not part and marked(attributes)
        aside = name in RAW or name in ASIDE and name != "form" and not part or told and self.number not in self.wraps
        if name not in VOID and not attributes.rstrip().endswith("/"):
            above = bool(self.open and self.open[-1][1]) and self.number != self.main
            self.open.append((name, aside or above, name in CONTENT or bool(self.open and self.open[-1][2]), self.number))
        return aside

    def close(self, at: int) -> None:
        """Close the open elements from a depth on."""
        del self.open[at:]

    def end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self.close(i)
                return
            if self.open[i][0] in CONTENT and name in INLINE | {"p"}:
                return

    @property
    def aside(self) -> bool:
        return bool(self.open and self.open[-1][1])

    @property
    def content(self) -> bool:
        return bool(self.open and self.open[-1][2])

    @property
    def block(self) -> str:
        for name, *_ in reversed(self.open):
            if name not in INLINE and name not in CONTENT:
                return name if name in KNOWN else "other"
        return "none"


class Extents(Place):
    """A first reading of a page: the words in each element, and the last element that starts in it."""

    def __init__(self):
        super().__init__()
        self.words, self.at, self.spans, self.told = 0, {}, {}, {}

    def start(self, name: str, attributes: str) -> bool:
        aside = super().start(name, attributes)
        if self.open and self.open[-1][3] == self.number and (name in CONTENT or name == "form" or aside):
            self.at[self.number], self.told[self.number] = self.words, (name, marked(attributes))
        return aside

    def close(self, at: int) -> None:
        for *_, number in self.open[at:]:
            if number in self.at:
                self.spans[number] = self.words - self.at[number], self.number
        super().close(at)


def wrappers(tokens: list[tuple[str, str, str]]) -> tuple[frozenset[int], int]:
    """The elements that hold the content element (without one: most of the page's words), and the content element (-1 for none).

    The content element is the ``<article>`` or ``<main>`` with the most words, the outer one of
    equals; one that a mark tells apart, as comments and teasers are, must hold most of the page's words.
    """
    read = Extents()
    for kind, name, attributes in tokens:
        if kind == "text":
            read.words += len(name.split())
        elif kind == "start":
            read.start(name, attributes)
        else:
            read.end(name)
    read.close(0)
    most = {n for n, (words, _) in read.spans.items() if 2 * words > read.words}
    own = [n for n in read.spans if read.told[n][0] in CONTENT and (n in most or not read.told[n][1])]
    main = max(own, key=lambda n: (read.spans[n][0], -n), default=-1)
    around = {n for n, (_, last) in read.spans.items() if n < main <= last}
    return frozenset(most if main < 0 else around), main


def features(page: str | None) -> list[tuple[str, int, bool, bool, str, str]]:
    """(feature, words, in content, aside, break, text) of each token; a feature is empty for the content marks.

    ``break`` is a blank where a new block starts.
    """
    tokens, out = list(tokenize(page or "")), []
    place = Place(*wrappers(tokens))
    for kind, name, attributes in tokens:
        if kind == "text":
            text = html.unescape(name)
            count = len(text.split())
            out.append((f"word {'aside' if place.aside else place.block}" if count else "", count, place.content, place.aside, "", text))
            continue
        before = place.content
        if kind == "start":
            aside = place.start(name, attributes)
            within = aside or place.aside
        else:
            aside = within = place.aside
            place.end(name)
        shown = name if name in KNOWN else "other"
        feature = "" if name in CONTENT else f"{kind} {'aside ' if aside else ''}{shown}"
        out.append((feature, 0 if not feature else 1, before and place.content, within, "" if name in INLINE else " ", ""))
    return out


def counts(pages: DataFrame, page: str = "html") -> DataFrame:
    """(feature, inside, outside) over all pages that mark their content; the features are a fixed, small set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for value in batch.column(0).slice(at, 64).to_pylist():
                    found = features(value)
                    if any(f[2] for f in found):
                        for feature, n, content, *_ in found:
                            if feature:
                                (inside if content else outside)[feature] += n
        names = sorted(inside | outside)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], names=["feature", "inside", "outside"])

    return pages.select(page).mapInArrow(count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def train(pages: DataFrame, page: str = "html") -> dict[str, float]:
    """Weight by feature: log odds of standing inside the content, and below zero for tags."""
    weights = {}
    for row in counts(pages, page).collect():
        odds = max(-STRONGEST, min(STRONGEST, math.log((row["inside"] + 0.5) / (row["outside"] + 0.5))))
        weights[row["feature"]] = odds if row["feature"].startswith("word ") else min(TAG, odds)
    return weights


def weight(feature: str, model: dict[str, float]) -> float:
    if not feature:
        return 0.0
    if feature in model:
        return model[feature]
    return PLAIN["aside"] if " aside" in feature else PLAIN["word"] if feature.startswith("word") else PLAIN["tag"]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the highest sum, in one pass; the first such, empty if no score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, model: dict[str, float]) -> str:
    tokens = features(page)
    # what is left out of the text anyway neither ends nor starts a run
    first, last = best_run([0.0 if aside else n * weight(feature, model) for feature, n, _, aside, *_ in tokens])
    return " ".join("".join(gap if gap else "" if aside else text for _, _, _, aside, gap, text in tokens[first:last]).split())


def extract(pages: DataFrame, model: dict[str, float], page: str = "html", keeps: list[str] | None = None) -> DataFrame:
    """Add ``main_text``: the text of the best run, references decoded, white space single.

    A null or empty page, and one where nothing scores above zero, gives an empty text.
    Pages are read alone and whole, so ties and repeated rows need no rule; a column called
    ``main_text`` is replaced.
    """
    return with_batches(pages, [page], pages.columns if keeps is None else keeps, [field("main_text", "string")], lambda: lambda texts: ([main_text(t, model) for t in texts],))
