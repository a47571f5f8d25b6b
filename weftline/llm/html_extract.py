"""Main text of web pages by a tree-structured graphical model.

A page becomes its element tree. Each element is content or not. Its own evidence (tag, names in class, id and role, how
much of its text are links, how much text it has) gives a unary potential; parent and child are tied by a pairwise
potential, one each for inline elements, blocks, and parts of lists and figures. All are counted on labelled pages. On a tree, sum-product message
passing is exact: one pass upward, one downward, and each element has its marginal. Text whose innermost element is
content with probability one half or more is kept: a paragraph in an advert falls with the advert, and a one-word
paragraph stays with its article.

White space (blanks, tabs and line ends; no-break and ideographic spaces are characters like others) inside a block becomes
one space, blocks are joined by a blank line, character references are decoded. A null or empty page has an empty text, an
empty table gives an empty one; broken or cut markup is read as far as it goes. Each page is one row of work in its task, in
time linear in its length however deep or broken it is. An element on the edge (log-odds of zero) is content. Repeated rows
give repeated results, and of the input only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES
from .html_labelled import pages as labelled_pages

#: Fixed values of HTML: elements without content, without visible text, and those that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas select textarea audio video".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Parts of a list or a figure, which are seldom other than the whole; cells of a table may be columns of a page.
PART = frozenset("caption dd dt figcaption legend li summary".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?=[A-Za-z])[^>]*(?:>|\Z)", re.S)
#: The same where a quote has no partner: the end of a tag is looked for by ``_tag_end``.
_ODD = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>\"']*)", re.S)
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"(class|id|role|y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SHUT = {name: re.compile(f"</{name}(?![A-Za-z0-9])", re.I) for name in RAW}
#: A slash that ends a tag, and no value without quotes such as ``href=/``.
_SELF = re.compile(r"(?:^|[\s\"'])/\s*$")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Log-odds are kept within this; a page as such holds content.
_CLIP, _ROOT = 30.0, 3.0


def _tag_end(source: str, at: int, doomed: set[int]) -> int | None:
    """Where a tag ends whose name ends at ``at``; None if a quote in it has no partner. ``doomed`` gets the opening quotes from which
    that one was reached, so that none of them is followed again: many such tags take time in proportion to the page."""
    seen = []
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.end()
        k = -1 if m.start() in doomed else source.find(m[0], m.end())
        seen.append(m.start())
        if k < 0:
            doomed.update(seen)
            return None
        at = k + 1
    return len(source)


class _Open:
    """The open elements, and for each tag (and for blocks other than ``p`` together) where those of it stand."""

    def __init__(self):
        self.stack, self.tags, self.at = [0], ["#"], {}

    def push(self, element: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK and tag != "p":
            self.at.setdefault("block", []).append(len(self.stack))
        self.stack.append(element)
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def cut(self, k: int) -> None:
        """Closes what stands from place ``k`` on; each element is closed once, so a page's work is linear."""
        for tag in self.tags[k:]:
            self.at[tag].pop()
            if tag in BLOCK and tag != "p":
                self.at["block"].pop()
        del self.stack[k:], self.tags[k:]


class Page:
    """Elements in document order (a parent before its children), and the text between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.mark = ["#"], [-1], [()], [None]
        self.items: list = []  # (element, text), or None where a block begins or ends
        opened, at, end = _Open(), 0, len(source)
        stack = opened.stack
        token, doomed, endless = _TOKEN, set(), set()
        dark = [False]  # for each element whether it is hidden or inside a hidden one
        while at < end:
            m = token.search(source, at)
            stop = m.start() if m else end
            if stop > at and self.tag[stack[-1]] == "head" and source[at:stop].strip(SPACES):
                opened.cut(len(stack) - 1)
            if stop > at and not dark[stack[-1]]:
                self.items.append((stack[-1], source[at:stop]))
            if not m:
                break
            at = m.end()
            close, name = m[1], m[2]
            if token is _TOKEN:
                inside = m[3]
                if not close and not name and source[stop + 1 : stop + 2].isalpha():  # a quote without a partner
                    token = _ODD
            elif name:
                after = _tag_end(source, at, doomed)
                inside = source[at : after - 1] if after is not None and source[after - 1] == ">" else source[at:after]
                at = after if after is not None else source.find(">", at) + 1 or end
                name = name if after is not None else None
            if close:
                if k := opened.last(close.lower()):
                    if max(opened.last("block"), opened.last("p")) >= k:
                        self.items.append(None)
                    opened.cut(k)
            elif name:
                name = name.lower()
                if self.tag[stack[-1]] == "head" and name not in HEAD:
                    opened.cut(len(stack) - 1)
                if name in VOID:
                    if not dark[stack[-1]]:
                        self.items.append(None if name == "hr" else (stack[-1], " "))
                    continue
                if name in BLOCK:
                    self.items.append(None)
                    self._close(opened, "p", ("button", "object", "template", "block"))
                if name in _CLOSES:
                    for x in _CLOSES[name][0].split():
                        self._close(opened, x, _CLOSES[name][1])
                self.tag.append(name)
                self.parent.append(stack[-1])
                dark.append(dark[stack[-1]] or name in HIDDEN)
                attrs = {a.lower(): (x or y or z) for a, x, y, z in _NAMES.findall(inside)} if inside else {}
                self.names.append(tuple(sorted({w.lower() for a in ("class", "id", "role") for w in _WORD.findall(attrs.get(a, ""))})))
                self.mark.append(attrs.get("y"))
                if name in RAW:
                    shut = None if name in endless else _SHUT[name].search(source, at)
                    if not shut:
                        endless.add(name)  # nor is there one further on
                    if shut:
                        at = source.find(">", shut.start()) + 1 or end
                    elif name in ("script", "style"):  # what has no end is cut off; other elements hold nothing then
                        at = end
                elif not _SELF.search(inside) or name in BLOCK:
                    opened.push(len(self.tag) - 1, name)
        # text and link text under each element
        n = len(self.tag)
        self.chars, self.links = [0] * n, [0] * n
        for x in self.items:
            if x:
                self.chars[x[0]] += len(x[1].strip(SPACES))
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "a":
                self.links[i] = self.chars[i]
            self.chars[self.parent[i]] += self.chars[i]
            self.links[self.parent[i]] += self.links[i]

    def _close(self, opened: _Open, name: str, stops: tuple) -> None:
        """Closes the last open ``name`` unless one of ``stops`` was opened after it."""
        k = opened.last(name)
        if k and k > max(map(opened.last, stops)):
            opened.cut(k)

    def features(self, i: int) -> list[str]:
        n, a = self.chars[i], self.links[i]
        share = 0 if not a else 1 + (a > 0.3 * n) + (a > 0.7 * n)
        return [f"t:{self.tag[i]}", f"l:{share}", *([f"b:{self.tag[i]}:{share}"] if share else []), f"n:{(n > 0) + (n > 20) + (n > 80) + (n > 300)}", *(f"c:{w}" for w in self.names[i])]


def _tie(tag: str) -> int:
    """Which pairwise potential ties an element to its parent."""
    return 2 if tag in PART else int(tag in BLOCK)


def _passes(up: list[float], parent: list[int], pairs: list) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on a tree whose parents stand before their children. ``up``: unary log-odds; ``pairs``: for each element
    the potentials by parent's and own state. Gives the marginals' log-odds, and for each element those of what is below
    and of the parent without it."""
    n = len(up)
    below, sent, cavity = list(up), [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        if parent[i] >= 0:
            (a00, a01), (a10, a11) = pairs[i]
            x = math.exp(max(-_CLIP, min(_CLIP, below[i])))
            sent[i] = math.log((a11 * x + a10) / (a01 * x + a00))
            below[parent[i]] += sent[i]
    whole = list(below)
    for i in range(1, n):
        if parent[i] >= 0:
            (a00, a01), (a10, a11) = pairs[i]
            cavity[i] = whole[parent[i]] - sent[i]
            x = math.exp(max(-_CLIP, min(_CLIP, cavity[i])))
            whole[i] += math.log((a11 * x + a01) / (a10 * x + a00))
    return whole, below, cavity


class Model:
    """Unary weights of features and potentials ``pair[kind][parent's state][own state]``, fitted together by maximum
    likelihood of the labelled trees: the gradient is what is observed less what the marginals expect."""

    def __init__(self, pages: list[str], steps: int = 200, rate: float = 0.1, shrink: float = 0.3):
        names, own, parent, label, block = {}, [], [], [], []
        for source in pages:
            page, first = Page(source), len(parent)
            for i in range(len(page.tag)):
                up = page.parent[i]
                own.append([names.setdefault(f, len(names)) for f in page.features(i)] if i else [])
                parent.append(first + up if i else -1)
                label.append(int(page.mark[i]) if page.mark[i] else label[first + up] if i else 1)
                block.append(_tie(page.tag[i]))
        n = len(parent)
        x = np.zeros((n, len(names)))
        for r, f in enumerate(own):
            x[r, f] = 1
        y, up, kind = np.array(label, float), np.array(parent), np.array(block)
        child = up >= 0
        seen = np.zeros((3, 2, 2))
        np.add.at(seen, (kind[child], y[up[child]].astype(int), y[child].astype(int)), 1)
        w, t = np.zeros(len(names)), np.tile([[1.0, -1.0], [0.0, 1.0]], (3, 1, 1))
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        for step in range(1, steps + 1):
            tied = [np.exp(t[k]).tolist() for k in range(3)]
            unary = np.where(child, x @ w, _ROOT)
            whole, below, cavity = map(np.array, _passes(unary.tolist(), parent, [tied[k] for k in block]))
            g_w = x.T @ (y - 1 / (1 + np.exp(-np.clip(whole, -_CLIP, _CLIP)))) - shrink * w
            # expected counts of (parent, own) states from both sides of each edge
            joint = np.exp(np.clip(cavity, -_CLIP, _CLIP))[:, None, None] ** np.array([[0, 0], [1, 1]]) * np.exp(np.clip(below, -_CLIP, _CLIP))[:, None, None] ** np.array([[0, 1], [0, 1]]) * np.array(tied)[kind]
            joint /= joint.sum((1, 2), keepdims=True)
            g_t = seen - np.array([joint[child & (kind == k)].sum(0) for k in range(3)]) - shrink * t
            for v, g, m, s in ((w, g_w, *moments[:2]), (t, g_t, *moments[2:])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        self.weight = {f: float(w[k]) for f, k in names.items()}
        self.pair = [np.exp(x).tolist() for x in t]

    def marginals(self, page: Page) -> list[float]:
        """Log-odds of content for each element."""
        weight = self.weight
        up = [sum(weight.get(f, 0.0) for f in page.features(i)) for i in range(len(page.tag))]
        up[0] = _ROOT
        return _passes(up, page.parent, [self.pair[_tie(t)] for t in page.tag])[0]


@lru_cache(maxsize=1)
def model() -> Model:
    return Model(labelled_pages())


def main_text(source: str | None, fitted: Model | None = None) -> str:
    if not source:
        return ""
    page = Page(source)
    odds = (fitted or model()).marginals(page)
    blocks, own = [], []
    for x in [*page.items, None]:
        if x is None:
            if block := _SPACE.sub(" ", html.unescape("".join(own))).strip(" "):
                blocks.append(block)
            own = []
        elif odds[x[0]] >= 0:
            own.append(x[1])
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row; url is null where the input has none."""
    kind = pages.schema[id_col].dataType.simpleString()
    fitted = model()  # a few hundred numbers, sent with the tasks

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), fitted) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    return pages.select(id_col, url, html_col).mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long")
