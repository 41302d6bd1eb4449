"""Main content of web pages: a tree-structured graphical model over the DOM.

Every element and every text is a node that is content or not.  A node's features (its tag, how much text and how
much of it in links, punctuation, depth, place) give its own potential; another table couples each child with its
parent.  Messages go up the tree and down again, by levels and for many pages at once, and give each node's exact
marginal.  The same marginals give the gradient of the likelihood in training.  Texts whose marginal reaches one half
make the page's content.

The labels come from pages that mark their content with ``<article>`` or ``<main>``: what is inside is content.  These two
names are hidden from the model, so that it works where a page does not say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm._sample import bounded_sample
from tabloom.llm._text import as_strings, slices

#: Labelled pages that the model is trained on, at most.
SAMPLE_ROWS = 300
#: Characters of a page that the model may be trained on; longer ones are read like all others.
SAMPLE_CHARS = 500_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[^<>]*>|[^<]+|<", re.S)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg".split())
#: Pages in which any element may close itself; in others, of RAW, only svg may.
XHTML = re.compile(r"\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<!doctype[^>]*\bxhtml\b", re.I | re.S)
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
LABELS = frozenset(["article", "main"])
KINDS = ("#text", "p", "div", "section", "li", "ul", "ol", "a", "b", "strong", "em", "i", "span", "h1", "h2", "h3", "nav", "footer", "header", "aside", "table", "tr", "td", "form", "body", "html", "pre", "blockquote")
KIND = {k: i for i, k in enumerate(KINDS)}
NUMBERS = 9
WIDTH = len(KINDS) + 1 + NUMBERS
_MARKS = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in document order: a parent comes before its children."""

    parent: list[int]
    depth: list[int]
    kind: list[int]
    label: list[bool]
    text: list[str | None]
    rank: list[int]
    marked: bool


def parsed(html: str) -> Page:
    """The tree of a page, lenient: unclosed elements end with their parent or where the next one says so."""
    page = Page([-1], [0], [KIND["html"]], [False], [None], [0], False)
    stack: list[tuple[str, int]] = [("html", 0)]
    open_names: dict[str, int] = {"html": 1}
    children = [0]

    def pop() -> None:
        name, _ = stack.pop()
        open_names[name] -= 1

    def add(kind: int, text: str | None, label: bool) -> int:
        up = stack[-1][1]
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1)
        page.kind.append(kind)
        page.label.append(label)
        page.text.append(text)
        page.rank.append(children[up])
        children[up] += 1
        children.append(0)
        return len(page.parent) - 1

    at, n, xhtml = 0, len(html), bool(XHTML.match(html))
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                if s.strip():
                    add(KIND["#text"], s, page.label[stack[-1][1]])
            continue
        name = name.lower()
        if m[1]:
            if open_names.get(name) and name != "html":
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            if m[0].endswith("/>") and (xhtml or name == "svg"):
                continue
            end = re.compile(f"</{name}\\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in VOID or m[0].endswith("/>") or name in ("html", "head"):
            continue
        while len(stack) > 1:
            top = stack[-1][0]
            if name in CLOSED_BY.get(top, ()) or (top in ("b", "strong", "em", "i", "span") and name in BLOCK and open_names.get("p")):
                pop()
            else:
                break
        inside = page.label[stack[-1][1]] or name in LABELS
        page.marked |= name in LABELS
        i = add(KIND.get("div" if name in LABELS else name, len(KINDS)), None, inside)
        stack.append((name, i))
        open_names[name] = open_names.get(name, 0) + 1
    return page


class Forest:
    """The trees of several pages as flat arrays."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        flat = lambda f, kind: np.array([x for p in pages for x in getattr(p, f)], kind)
        parent = flat("parent", np.int64)
        self.parent = np.where(parent < 0, -1, parent + np.repeat(self.first, sizes))
        self.depth, kind, self.label, rank = flat("depth", np.int64), flat("kind", np.int64), flat("label", bool), flat("rank", np.float64)
        n = len(self.parent)
        own = np.array([[len(t), t.count(" ") + 1, len(_MARKS.findall(t))] if t else [0, 0, 0] for p in pages for t in p.text], np.float64).reshape(n, 3)
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)] if n and self.depth.max() < 64 else self._levels()
        link = own[:, 0] * 0
        in_link = kind == KIND["a"]
        for at in self.levels[1:]:
            in_link[at] |= in_link[self.parent[at]]
        link[in_link] = own[in_link, 0]
        total = np.column_stack([own, link, np.ones(n)])
        for at in self.levels[:0:-1]:
            np.add.at(total, self.parent[at], total[at])
        x = np.zeros((n, WIDTH))
        x[np.arange(n), kind] = 1
        chars, words, marks, linked, nodes = total.T
        up = np.maximum(self.parent, 0)
        text = kind == 0
        x[:, -NUMBERS:] = np.column_stack([np.ones(n), np.log1p(chars) / 5, linked / np.maximum(chars, 1), np.minimum(marks / np.maximum(words, 1) * 5, 2), np.minimum(self.depth, 20) / 10, np.minimum(rank, 20) / 10, np.log1p(nodes) / 5, chars / np.maximum(chars[up], 1), text * np.log1p(chars) / 5])
        self.x, self.text = x, text

    def _levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(forest: Forest, own: np.ndarray, couple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(node = s), P(parent = r, node = s) and the log partition of each page, by messages up and down.

    ``own`` [nodes, 2] and ``couple`` [2 kinds of child, parent's state, child's state] are log potentials.
    """
    n = len(forest.parent)
    belief, up = own.copy(), np.zeros((n, 2))
    kind = forest.text.astype(np.int64)
    for at in forest.levels[:0:-1]:
        c = couple[kind[at]]
        up[at] = _lse(belief[at, None, 0] + c[:, :, 0], belief[at, None, 1] + c[:, :, 1])
        np.add.at(belief, forest.parent[at], up[at])
    inner = belief.copy()  # a node with all below it
    roots = forest.levels[0] if len(forest.levels) else np.zeros(0, np.int64)
    z = np.zeros(len(forest.first))
    z[forest.page[roots]] = _lse(belief[roots, 0], belief[roots, 1])
    pair = np.zeros((n, 2, 2))
    for at in forest.levels[1:]:
        cavity = belief[forest.parent[at]] - up[at]
        joint = cavity[:, :, None] + couple[kind[at]] + inner[at][:, None, :]
        belief[at] += _lse(cavity[:, 0, None] + couple[kind[at]][:, 0, :], cavity[:, 1, None] + couple[kind[at]][:, 1, :])
        pair[at] = np.exp(joint - z[forest.page[at]][:, None, None])
    return np.exp(belief - z[forest.page][:, None]), pair, z


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # [WIDTH], the log odds of content
    couple: np.ndarray  # [2, 2, 2]

    def content(self, forest: Forest) -> np.ndarray:
        """P(content) of each node."""
        own = np.column_stack([np.zeros(len(forest.x)), forest.x @ self.weights])
        return marginals(forest, own, self.couple)[0][:, 1]


def train(pages: list[Page], steps: int = 150) -> Model:
    """Gradient ascent (Adam) on the penalised likelihood of the labels; without pages all is content as likely as not."""
    weights, couple = np.zeros(WIDTH), np.zeros((2, 2, 2))
    pages = [p for p in pages if p.marked]
    if not pages:
        return Model(weights, couple)
    forest = Forest(pages)
    y, kind = forest.label.astype(np.int64), forest.text.astype(np.int64)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[inner], y[forest.parent[inner]], y[inner]), 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, couple)]
    for step in range(1, steps + 1):
        one, pair, _ = marginals(forest, np.column_stack([np.zeros(len(y)), forest.x @ weights]), couple)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, kind[inner], pair[inner])
        n = len(y)
        for p, g, s in zip((weights, couple), (forest.x.T @ (y - one[:, 1]) / n - 1e-4 * weights, (seen - expected) / n - 1e-4 * couple), state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p += 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-9)
    return Model(weights, couple)


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS) -> Model:
    """Trained on ``rows`` pages at most, those of least hashed id among the pages that mark their content.

    An id counts once, with its least page.  Null ids and pages, and pages of more than ``most_chars`` characters, are
    not used, so what the driver gets is bounded.  Without any page all is content as likely as not.
    """
    pages = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("id is not null").where(F.length("html") <= most_chars).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    return train([parsed(h) for h in sorted(r["html"] for r in bounded_sample(pages, "id", rows).collect())])


def extracted_texts(pages: list[Page], p: np.ndarray, first: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(text, content texts, texts, mean certainty of the texts) of each page."""
    out = []
    inline = {KIND[k] for k in ("a", "b", "strong", "em", "i", "span")}
    for page, start in zip(pages, first.tolist(), strict=True):
        parts, kept, texts, sure, last = [], 0, 0, 0.0, None
        for i, t in enumerate(page.text):
            if t is None:
                continue
            texts += 1
            q = float(p[start + i])
            sure += max(q, 1 - q)
            if q >= 0.5:
                kept += 1
                block = page.parent[i]
                while page.kind[block] in inline:
                    block = page.parent[block]
                parts.append(("" if block == last else "\n") + unescape(t))
                last = block
        text = "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in "".join(parts).split("\n")) if x)
        out.append((text, kept, texts, round(sure / texts, 6) if texts else 0.0))
    return out


SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("content_nodes", T.IntegerType()), T.StructField("text_nodes", T.IntegerType()), T.StructField("certainty", T.DoubleType())])


def content(model: Model, html: Column) -> Column:
    """struct(text, content_nodes, text_nodes, certainty); null for a null page, an empty text for an empty one."""

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts, rows = as_strings(column), []
            for _, part in slices(texts):
                pages = [parsed(h) for h in part.to_pylist()]
                forest = Forest(pages)
                rows += extracted_texts(pages, model.content(forest), forest.first)
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], fields=[pa.field(f.name, k) for f, k in zip(SCHEMA, kinds, strict=True)], mask=column.is_null())

    return run(html)


def extracted(df: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, content_nodes, text_nodes, certainty), one row for each of ``df``; other columns are not looked at."""
    return df.select(F.col(id_col).alias("page_id"), content(model, F.col(html_col)).alias("x")).select("page_id", "x.*")
