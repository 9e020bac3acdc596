"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements break the page
into lines.  A line is made of pieces of text, each booked to the element that is
open when it comes; scripts, icons, buttons and the like inside a block neither
end it nor own its text.  Each line has a ratio of its text to its tags; text
inside elements that are boilerplate by their nature (menus, footers, forms), by a
whole name of their class, id or role (``sidebar``, ``cookie-banner``, not
``no-sidebar``), or hidden doesn't count, unless that element holds the page's content.
Ratios are smoothed by a Gaussian over neighbouring lines; lines whose smoothed
ratio reaches a share of the largest form clusters.  The content region is the
article or main element with most of the clusters' text, all articles if they
hold it together, or the smallest element around it; every line of it that
isn't boilerplate is kept, however short.

Everything is linear in the page's length: open elements are kept in stacks by
name, and sums go up and down the elements once.

Defined results: a null, empty or text-free page gives an empty text; nothing
is capped; repeated rows give repeated results; an empty table gives an empty
table; input columns are kept and clashing ones replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, table, texts_of

#: Width of the Gaussian, in lines, and the share of the largest smoothed ratio that makes a line content.
SIGMA, SHARE = 1.5, 0.12
#: Share of the content lines' text that the content region must hold; share at which one article is it.
HELD, ONE = 0.95, 0.8
#: Share of a page's text at which an element isn't boilerplate by its name: with a first heading inside, and without.
MOST, NEARLY_ALL = 0.5, 0.9

# HTML elements by their role.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SECTIONS = frozenset("article body center div main section table td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head nav footer aside menu dialog".split())
#: What is inside these is no text, and not a part of the block around them.
SILENT = frozenset("script style title noscript template iframe object svg math canvas select button textarea audio video".split())
# Words in class, id or role that mark boilerplate, and words that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies responses reviews share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split())
BESIDE = frozenset("area bar block body bottom box container global group inner item items left link links list main outer page panel primary right secondary section site text thread top unit user users customer reader wrap wrapper".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
#: End tags of these don't reach beyond the nearest of SCOPES.
LOOSE, SCOPES = frozenset("p li b i a span".split()), ("article", "body")
#: What a start tag ends: the nearest open element of a name, unless one of the others is nearer.
ENDS = {
    "li": (("li", ("ul", "ol", "menu")),),
    **dict.fromkeys(("dd", "dt"), (("dd", ("dl",)), ("dt", ("dl",)))),
    **dict.fromkeys(("td", "th"), (("td", ("table", "tr")), ("th", ("table", "tr")))),
    "tr": (("td", ("table", "tr")), ("th", ("table", "tr")), ("tr", ("table",))),
}
_CAMEL, _PART = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def marked(value: str) -> bool:
    """One of the value's names says boilerplate: all its parts are marks, or words that may stand beside one."""
    for name in value.split():
        parts = _PART.findall(_CAMEL.sub("-", name).lower())
        if not MARKS.isdisjoint(parts) and all(x in MARKS or x in BESIDE for x in parts):
            return True
    return False


NONE, SOFT, HARD = range(3)


class Lines(HTMLParser):
    """Lines of a page and its elements: parent, tag and mark of each; 0 is the page.

    A line is its pieces, (text, element), and its number of tags.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.mark = [0], ["page"], [NONE]
        # open elements, and the places in that stack of each name, of all blocks and of all silent ones
        self.open: list[int] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.silent: list[int] = []
        self.lines: list[tuple[list[tuple[str, int]], int]] = []
        self.pieces: list[tuple[str, int]] = []
        self.tags = 0

    def flush(self):
        if self.pieces:
            if any(not t.isspace() for t, _ in self.pieces):
                self.lines.append((self.pieces, self.tags))
                self.tags = 0
            self.pieces = []

    def kind(self, tag, attrs) -> int:
        if tag in SKIP or tag in SILENT:
            return HARD
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and _HIDDEN.search(v)):
                return HARD
        if tag == "header":
            return NONE if self.places["article"] or self.places["main"] or self.places["section"] else HARD
        if tag in ("article", "main", "body", "html") and not any(k in ("class", "id") and v and "comment" in v.lower() and marked(v) for k, v in attrs):
            return NONE
        return SOFT if tag == "form" or any(k in ("class", "id", "role") and v and marked(v) for k, v in attrs) else NONE

    def begin(self, tag, attrs):
        self.parent.append(self.open[-1] if self.open else 0)
        self.mark.append(self.kind(tag, attrs))
        self.tag.append(tag)
        for stack in self.stacks(tag):
            stack.append(len(self.open))
        self.open.append(len(self.tag) - 1)

    def stacks(self, tag):
        yield self.places[tag]
        if tag in BLOCK:
            yield self.blocks
        if tag in SILENT:
            yield self.silent

    def end(self, place):
        """Ends the open elements from this place on."""
        for e in self.open[place:]:
            for stack in self.stacks(self.tag[e]):
                stack.pop()
        del self.open[place:]

    def nearest(self, *names) -> int:
        """The place of the innermost open element of these names, -1 if there's none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag not in VOID:
                self.begin(tag, attrs)
            return
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in BLOCK:
            self.flush()
            # a paragraph ends where a block begins in it
            if tag in CLOSES_P and self.blocks and self.tag[self.open[self.blocks[-1]]] == "p":
                self.end(self.blocks[-1])
            for name, barrier in ENDS.get(tag, ()):
                place = self.nearest(name)
                if place > self.nearest(*barrier):
                    self.end(place)
        if tag in VOID:
            return
        if tag in BLOCK or tag in SKIP or tag in SILENT or attrs:
            self.begin(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        # only drawings have elements that end by themselves; in a page's own the slash says nothing
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br" and (len(self.silent) > (tag in SILENT) or tag in ("svg", "math")):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        place = self.nearest(tag)
        inside = self.silent and place >= self.silent[0]
        if not inside:
            if self.silent and (place < 0 or tag not in BLOCK):
                return
            self.tags += 1
            if tag in BLOCK or tag in SKIP:
                self.flush()
        if place > (self.nearest(*SCOPES) if tag in LOOSE else -1):
            self.end(place)

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append((data, self.open[-1] if self.open else 0))

    def sums(self, of_elements: list[float]) -> list[float]:
        """For each element, the sum over itself and the elements inside it."""
        out = list(of_elements)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inside(self, chosen: list[bool]) -> list[bool]:
        """For each element, whether it's one of the chosen or inside one."""
        held = list(chosen)
        for e in range(1, len(held)):
            held[e] = held[e] or held[self.parent[e]]
        return held

    def booked(self, out: list[bool]) -> list[int]:
        """For each element, the characters of its own pieces, without those that are out."""
        size = [0] * len(self.tag)
        for pieces, _ in self.lines:
            for text, e in pieces:
                if not out[e]:
                    size[e] += len(text)
        return size

    def boilerplate(self) -> list[bool]:
        """For each element, whether it's boilerplate or inside such a one.

        A class or an id can err, and a form may hold a page: an element that holds a first heading (or a main element)
        and most of the page's text, or nearly all of it and, if it's a form, a paragraph, isn't boilerplate by its name.
        """
        hard = self.inside([m == HARD for m in self.mark])
        size = self.sums(self.booked(hard))
        heads = self.sums([t in ("h1", "main") for t in self.tag])
        prose = self.sums([t == "p" for t in self.tag])
        whole = [size[e] >= (MOST if heads[e] else NEARLY_ALL) * size[0] and (heads[e] or prose[e] or self.tag[e] != "form") for e in range(len(size))]
        return self.inside([m == HARD or (m == SOFT and not w) for m, w in zip(self.mark, whole)])


def smoothed(ratios: list[float]) -> list[float]:
    import numpy as np

    r = int(3 * SIGMA)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / SIGMA) ** 2)
    return np.convolve(np.asarray(ratios, float), k / k.sum(), "full")[r : r + len(ratios)].tolist()


#: What would begin a tag or a comment.
_OPENING = re.compile(r"<[a-zA-Z/!?]")


def without_open_end(html: str) -> str:
    """html without a tag that never ends: nothing behind its ``<`` is text."""
    m = _OPENING.search(html, html.rfind(">") + 1)
    return html[: m.start()] if m else html


def outermost(p: Lines, chosen: list[int]) -> list[int]:
    """Those of the chosen elements that no other one holds."""
    own = [False] * len(p.tag)
    for e in chosen:
        own[e] = True
    held = p.inside(own)
    return [e for e in chosen if not held[p.parent[e]]]


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks in order, joined by an empty line."""
    p = Lines()
    p.feed(without_open_end(html or ""))
    p.close()
    p.flush()
    dull = p.boilerplate()
    # text and tags of each line, and the element that most of it lies in
    texts, owner = [], []
    for pieces, _ in p.lines:
        good = [(t, e) for t, e in pieces if not dull[e]]
        texts.append(" ".join("".join(t for t, _ in good).split()))
        owner.append(max(((len(t), -e) for t, e in good if not t.isspace()), default=(0, 0))[1] * -1)
    if not any(texts):
        return ""
    smooth = smoothed([len(t) / (tags + 1) for t, (_, tags) in zip(texts, p.lines)])
    least = SHARE * max(smooth)
    hot = [0] * len(p.tag)
    filled = [0] * len(p.tag)
    for text, e, s in zip(texts, owner, smooth):
        if text:
            hot[e] += len(text) if s >= least else 0
            filled[e] += 1
    # clusters of hot lines weigh for each element that holds them
    weight, n_lines = p.sums(hot), p.sums(filled)
    named = [e for e, tag in enumerate(p.tag) if tag in ("article", "main") and weight[e]]
    best = max(named, key=lambda e: (weight[e], e), default=0)
    region = [best]
    if not named or weight[best] < ONE * weight[0]:
        # several articles together, or the innermost element that holds nearly all, and more than a single line
        region = outermost(p, named)
        if sum(weight[e] for e in region) < HELD * weight[0]:
            region = [max((e for e, tag in enumerate(p.tag) if tag in SECTIONS and n_lines[e] > 1 and weight[e] >= HELD * weight[0]), default=0)]
    own = [False] * len(p.tag)
    for e in region:
        own[e] = True
    kept = p.inside(own)
    return "\n\n".join(t for t, e in zip(texts, owner) if t and kept[e])


def extract_text(df: DataFrame, html_col: str = "html", keep_html: bool = True) -> DataFrame:
    """df with text (the page's main text) and n_chars (its code points)."""
    added = T.StructType().add("text", "string").add("n_chars", "long")

    def make():
        def f(batch):
            texts = [main_text(h) for h in texts_of(batch, html_col)]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return f

    return arrow_map(df, added, make, html_col, () if keep_html else (html_col,))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, keep_html=False).select("page_id", "url", "text", "n_chars")
