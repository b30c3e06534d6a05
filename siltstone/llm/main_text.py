"""The main text of a page: boosted trees over the nodes of its document tree, decoded from the top down.

A page becomes an outline: its block elements, and a run of text beside blocks as a node of its own; inline markup is part of
the text around it.  Each node has features of its subtree (characters, density of text and of links, sentences), its attribute
tokens and those above it, its depth and place, and its siblings.  Trees give each node log-odds of holding main text.  They are trained
on pages whose main text is known: those of a bounded sample that mark it by an element, and layouts that :mod:`.page_layouts` draws
around their sentences.

Decoding: a node that is left out takes all below it with it, so the kept nodes are the set, closed towards the root, whose sum of
log-odds is greatest; no node is kept under one that is not.

Scale: the forest is some thousand numbers in the task's closure; a page is one row of one scan, without a shuffle.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tree import Node, parse
from . import boost, page_layouts
from .common import quoted
from .hashing import pieces

#: Pages of the sample, and the longest one that is drawn into it, so the driver gets 10 MB at most.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 50_000
#: Layouts that are drawn around the sample's sentences.
LAYOUTS = 1500
#: Log-odds of a node count no more than this either way.
CLIP = 5.0

# Elements that hold no text to read, and those that break a line of text.
SILENT = frozenset("head script style noscript template iframe object svg math canvas select datalist textarea button audio video map title".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split())
#: Kinds of elements that the trees tell apart.
KINDS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu", "dir"), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",), ("article",), ("main",), ("section",), ("div", "center"), ("form", "fieldset", "legend"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("figure", "figcaption"), ("blockquote", "pre"), ("#run",), ("dialog", "details", "summary", "address")]
_KIND = {tag: k for k, tags in reversed(list(enumerate(KINDS))) for tag in tags}
_FAMILY = {token: k for k, tokens in enumerate(page_layouts.FAMILIES.values()) for token in tokens}
_NKINDS, _NFAMILIES = len(KINDS), len(page_layouts.FAMILIES)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = (".", "!", "?")
#: What an attribute of the training pages says of a node's text.
MARK = "data-main"


def families_of(node: Node) -> int:
    """The families of a node's attribute tokens, as bits."""
    bits = 0
    for name in ("class", "id", "role", "aria-label", "itemprop"):
        if value := node.attrs.get(name):
            for token in _TOKEN.findall(value[:500]):
                token = token.lower()
                family = _FAMILY.get(token, _FAMILY.get(token.removesuffix("s")))
                if family is not None:
                    bits |= 1 << family
    return bits


class Outline:
    """Nodes in page order, a parent before its children; ``text`` is what stands in a node itself, ``main`` what is known of it."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.bits, self.text, self.linked, self.depth, self.main, self.inputs = [-1], ["#page"], [0], [""], [0], [0], [False], [0]
        self._read(parse(html))

    def _add(self, parent: int, tag: str, bits: int, main: bool) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.bits, bits), (self.text, ""), (self.linked, 0), (self.depth, self.depth[parent] + 1), (self.main, main), (self.inputs, 0)):
            column.append(value)
        return len(self.parent) - 1

    def _flush(self, at: int, run: list[str], linked: int, main: bool) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            k = self._add(at, "#run", 0, main)
            self.text[k], self.linked[k] = text, linked

    def _read(self, root: Node) -> None:
        # each step of the walk: an element that begins, one that ends, or a string
        todo: list = [(c, False) for c in reversed(root.children)]
        at, run, linked, links, marks = 0, [], 0, 0, [False]
        while todo:
            node, ends = todo.pop()
            if isinstance(node, str):
                run.append(node)
                if links:
                    linked += len("".join(node.split()))
            elif ends:
                if node.tag in BLOCKS:
                    self._flush(at, run, linked, marks[-1])
                    linked = 0
                    if self.parent[-1] == at and self.tag[-1] == "#run" and len(self.parent) - 2 == at:
                        # all that the block has is one run: they are one node
                        text, own = self.text.pop(), self.linked.pop()
                        for column in (self.parent, self.tag, self.bits, self.depth, self.main, self.inputs):
                            column.pop()
                        self.text[at], self.linked[at] = text, own
                    at = self.parent[at]
                    marks.pop()
                elif node.tag == "a":
                    links -= 1
            elif node.tag in SILENT or "hidden" in node.attrs:
                if node.tag in ("button", "select", "textarea"):
                    self.inputs[at] += 1
                run.append(" ")
            elif node.tag in BLOCKS:
                self._flush(at, run, linked, marks[-1])
                linked = 0
                known = node.attrs.get(MARK)
                marks.append(marks[-1] if known is None else known == "1")
                at = self._add(at, node.tag, families_of(node), marks[-1])
                todo.append((node, True))
                todo += [(c, False) for c in reversed(node.children)]
            else:
                if node.tag == "br":
                    run.append(" ")
                elif node.tag == "input":
                    self.inputs[at] += 1
                if node.tag == "a":
                    links += 1
                    todo.append((node, True))
                todo += [(c, False) for c in reversed(node.children)]
        self._flush(at, run, linked, marks[-1])

    def known(self) -> np.ndarray:
        """Whether each node holds text that is known to be main."""
        holds = np.array([bool(m and t) for m, t in zip(self.main, self.text, strict=True)])
        for k in range(len(holds) - 1, 0, -1):
            if holds[k]:
                holds[self.parent[k]] = True
        return holds

    def decoded(self, odds: np.ndarray) -> str:
        """The text of the nodes that are kept, of the log-odds of all but the page itself."""
        worth = np.concatenate([[0.0], np.clip(odds, -CLIP, CLIP)]).tolist()
        for k in range(len(worth) - 1, 0, -1):
            if worth[k] > 0:
                worth[self.parent[k]] += worth[k]
        kept = [True] * len(worth)
        for k in range(1, len(worth)):
            kept[k] = kept[self.parent[k]] and worth[k] > 0
        return " ".join(t for t, keep in zip(self.text, kept, strict=True) if keep and t)


def features(outlines: list[Outline]) -> np.ndarray:
    """A row for each node of each outline but the pages themselves."""
    sizes = [len(o.parent) for o in outlines]
    n, starts = sum(sizes), np.cumsum([0, *sizes[:-1]])
    page = np.repeat(starts, sizes)
    joined = lambda column, kind=np.float64: np.array([x for o in outlines for x in getattr(o, column)], dtype=kind)
    parent = joined("parent", np.int64) + page
    parent[starts] = starts
    tags, strings = [t for o in outlines for t in o.tag], [t for o in outlines for t in o.text]
    depth, bits = joined("depth", np.int64), joined("bits", np.int64)
    kind = np.array([_KIND.get(t, _NKINDS) for t in tags], dtype=np.int64)
    own = np.array([len(t) for t in strings], dtype=np.float64)
    h1 = np.array([t == "h1" for t in tags], dtype=np.float64)
    sums = np.zeros((n, 10))
    sums[:, 0], sums[:, 1] = own, joined("linked")
    sums[:, 2] = [t.count(" ") + 1 if t else 0 for t in strings]
    sums[:, 3] = [t.count(". ") + t.count("! ") + t.count("? ") + t.endswith(_ENDS) if t else 0 for t in strings]
    sums[:, 4], sums[:, 5], sums[:, 6] = kind == _KIND["p"], kind == _KIND["li"], joined("inputs")
    sums[:, 7], sums[:, 8], sums[:, 9] = own > 0, 1, h1
    kinds = np.where(kind < _NKINDS, 1 << kind, 0)
    over, kinds_over = np.zeros(n, np.int64), np.zeros(n, np.int64)
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
    for at in levels:
        over[at] = over[parent[at]] | bits[parent[at]]
        kinds_over[at] = kinds_over[parent[at]] | kinds[parent[at]]
    for at in reversed(levels):
        np.add.at(sums, parent[at], sums[at])
    chars, linked, words, sentences, ps, lis, inputs, texts, nodes, h1s = sums.T
    # siblings stand together, in page order, once sorted by parent
    inside = np.flatnonzero(np.arange(n) != page)
    order = inside[np.argsort(parent[inside], kind="stable")]
    rank, siblings, left, right = np.zeros(n), np.zeros(n), np.full(n, -1), np.full(n, -1)
    alike = np.zeros(n)
    if len(order):
        same = parent[order[1:]] == parent[order[:-1]]
        left[order[1:][same]], right[order[:-1][same]] = order[:-1][same], order[1:][same]
        begins = np.concatenate([[0], np.flatnonzero(~same) + 1])
        counts = np.diff(np.append(begins, len(order)))
        rank[order] = np.arange(len(order)) - np.repeat(begins, counts)
        siblings[order] = np.repeat(counts, counts) - 1
        _, which, many = np.unique(parent[inside] * (_NKINDS + 1) + kind[inside], return_inverse=True, return_counts=True)
        alike[inside] = many[which] - 1
    beside = lambda at, v: np.where(at >= 0, v[at], -1.0)
    upto, heads = np.cumsum(own), np.cumsum(h1)
    before, headed = upto - own - (upto - own)[page], (heads - (heads - h1)[page] > 0).astype(np.float64)
    density, width, size, total = linked / np.maximum(chars, 1), chars / np.maximum(texts, 1), np.log1p(chars), np.maximum(chars[page], 1)
    columns = [
        size, density, np.log1p(words), chars / np.maximum(words, 1), sentences / np.maximum(words, 1), np.log1p(sentences), width,
        np.log1p(ps), np.log1p(lis), inputs / np.maximum(texts, 1), np.minimum(inputs, 5), np.log1p(nodes), chars / np.maximum(nodes, 1), h1s, headed, depth,
        rank, siblings - rank, np.log1p(siblings), alike, chars / np.maximum(chars[parent], 1), chars / total, before / total, (before + chars) / total,
        density[parent], size[parent], width[parent], beside(left, density), beside(right, density), beside(left, size), beside(right, size), beside(left, width), beside(right, width),
    ]
    table = [np.stack(columns, axis=1)]
    for masks, wide in ((bits, _NFAMILIES), (over, _NFAMILIES), (kinds, _NKINDS), (kinds_over, _NKINDS)):
        table.append(((masks[:, None] >> np.arange(wide)) & 1).astype(np.float64))
    return np.concatenate(table, axis=1)[inside]


def marked(html: str) -> str | None:
    """A page with its only article, or main element, marked as its main text; None if it has no such element."""
    for tag in ("article", "main"):
        if len(starts := re.findall(rf"<{tag}\b", html, re.I)) == 1:
            return html.replace(starts[0], f'{starts[0]} {MARK}="1"', 1)
    return None


def fit(pages: DataFrame, *, html_col: str = "html", sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS, seed: int = 11) -> boost.Forest:
    """Trees from at most ``sample`` pages of at most ``SAMPLE_CHARS`` characters, those of the least hashes of their html, and ``layouts`` drawn ones.

    A first scan counts different pages; of the second only those below a hash that leaves about twice the sample come to the driver.
    Pages without text give none; then layouts are drawn around made-up words.  Rows that repeat count once.
    """
    html = F.col(quoted(html_col))
    known = pages.where(html.isNotNull() & (F.length(html) <= SAMPLE_CHARS)).select(html.alias("html"), F.shiftrightunsigned(F.xxhash64(html), 1).alias("h"))
    different = known.agg(F.approx_count_distinct("h")).first()[0]
    below = ((1 << 63) - 1) * 2 * sample // max(different, 2 * sample)
    drawn = known.where(F.col("h") <= below).distinct()
    rows = [r["html"] for r in sorted(drawn.collect(), key=lambda r: (r["h"], r["html"]))][:sample]
    outlines = [Outline(m) for m in map(marked, rows) if m]
    long, short = page_layouts.material(Outline(r) for r in rows)
    rng = random.Random(seed)
    outlines += [Outline(page_layouts.drawn(rng, long, short, MARK)) for _ in range(layouts)]
    labels = [o.known()[1:] for o in outlines]
    return boost.fit(features(outlines), np.concatenate(labels).astype(np.float64))


def texts(htmls: Iterable[str | None], forest: boost.Forest) -> list[str]:
    outlines = [Outline(h) for h in htmls]
    odds = forest.margins(features(outlines)) if outlines else []
    out, at = [], 0
    for o in outlines:
        ends = at + len(o.parent) - 1
        out.append(o.decoded(odds[at:ends]))
        at = ends
    return out


def extracted(pages: DataFrame, forest: boost.Forest, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each, from the whole html, and ``n_chars``, its code points; columns of these names are replaced.

    Null and empty pages, and pages without main text, give an empty text.  A page of any length is read whole; rows that
    repeat have one text; an empty table gives no rows.
    """

    @F.arrow_udf("string")
    def main(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in pieces(batches, 32):
            yield pa.array(texts(part.to_pylist(), forest), type=pa.string())

    made = pages.withColumn(text_col, main(F.col(quoted(html_col))))
    return made.withColumn("n_chars", F.length(F.col(quoted(text_col))).cast("long"))
