"""HTML extraction: a graphical model over the DOM tree, with sum-product messages up and down, trained from labelled pages."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
_VOID = {"br", "img", "meta", "link", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_CLOSES = {"p": "p", "li": "li", "td": "td", "th": "th", "tr": "tr", "option": "option", "dt": "dt", "dd": "dd"}
_BLOCK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "article", "section", "nav", "footer", "header", "main", "aside", "blockquote", "pre", "title", "body", "head", "html"}
#: Tag groups. Elements whose name itself says what is content (article, main, nav, footer, header, aside) are all "other", as the labels come from them.
_GROUPS = {"p": 0, "blockquote": 0, "pre": 0, "li": 1, "ul": 1, "ol": 1, "dl": 1, "a": 2, **{f"h{i}": 3 for i in range(1, 7)}, **dict.fromkeys(("b", "i", "em", "strong", "span", "u", "code"), 4), "div": 5, **dict.fromkeys(("title", "head", "meta", "link", "base"), 6), **dict.fromkeys(("table", "tr", "td", "th", "tbody"), 7), **dict.fromkeys(("button", "form", "input", "label", "select", "option"), 8), "body": 9, "html": 9}
_OTHER, _TEXT, N_GROUPS = 10, 11, 12
N_FEATURES = N_GROUPS * 2 + 8


def parse(page: str) -> tuple[list[int], list[int], list[bool], list[str | None], list[str], list[bool]]:
    """The DOM nodes in document order: parent, group, has class or id, text (None for elements), name, under an article.

    Text runs are nodes. Comments, scripts and styles are left out. End tags without a start are ignored; what
    is left open ends with its parent; p, li and table parts close an open one of their kind.
    """
    parent, group, marked, text, name, under = [-1], [9], [False], [None], [""], [False]
    stack, opened = [0], {}
    at = 0

    def run(upto: int) -> None:
        piece = page[at:upto]
        if piece and not piece.isspace():
            parent.append(stack[-1])
            group.append(_TEXT)
            marked.append(False)
            text.append(piece)
            name.append("")
            under.append(under[stack[-1]])

    def close(tag: str) -> None:
        while len(stack) > 1:
            top = name[stack.pop()]
            opened[top] -= 1
            if top == tag:
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run(m.start())
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2):
            if opened.get(tag):
                close(tag)
            continue
        if _CLOSES.get(tag) and opened.get(tag):
            close(tag)
        attributes = m.group(4)
        parent.append(stack[-1])
        group.append(_GROUPS.get(tag, _OTHER))
        marked.append("class" in attributes or "id=" in attributes)
        text.append(None)
        name.append(tag)
        under.append(under[stack[-1]] or tag == "article")
        if tag not in _VOID and not attributes.endswith("/"):
            stack.append(len(parent) - 1)
            opened[tag] = opened.get(tag, 0) + 1
    run(len(page))
    return parent, group, marked, text, name, under


@dataclass
class Forest:
    """The trees of several pages, one after the other; levels are the nodes by depth, the roots first."""

    page: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    x: np.ndarray
    edge: np.ndarray
    text: list[str | None]
    name: list[str]
    under: np.ndarray

    @classmethod
    def of(cls, pages: list[str]) -> Forest:
        page, parent, group, marked, text, name, under = [], [], [], [], [], [], []
        for k, p in enumerate(pages):
            base = len(parent)
            a, g, m, t, n, u = parse(p)
            parent += [x + base if x >= 0 else -1 for x in a]
            page += [k] * len(a)
            group += g
            marked += m
            text += t
            name += n
            under += u
        parent, group = np.array(parent, np.int64), np.array(group, np.int64)
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for i, p in enumerate(parent.tolist()):  # parents come first
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
        chars = np.array([len(t) if t else 0 for t in text], np.float64)
        stops = np.array([t.count(".") + t.count(",") if t else 0 for t in text], np.float64)
        links = np.where((group == _TEXT) & (group[np.maximum(parent, 0)] == 2), chars, 0.0)
        kids = np.zeros(n)
        for level in reversed(levels[1:]):
            for v in (chars, stops, links):
                np.add.at(v, parent[level], v[level])
            np.add.at(kids, parent[level], 1)
        up = np.maximum(parent, 0)
        x = np.zeros((n, N_FEATURES))
        x[np.arange(n), group] = 1
        x[np.arange(n), N_GROUPS + group[up]] = 1
        long = np.log1p(chars) / 5
        link = links / np.maximum(chars, 1)
        x[:, -8:] = np.stack([np.ones(n), long, link, 10 * stops / np.maximum(chars, 1), np.array(marked, float), np.array(marked, float)[up], long[up], np.log1p(kids)[up] / 3], axis=1)
        return cls(np.array(page, np.int64), parent, levels, x, (group == _TEXT).astype(np.int64), text, name, np.array(under, bool))

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum-product on every tree at once: the chance of content at each node, the joint with its parent (node, parent's state, own state), and log Z of each page.

        w: features x 1, the log-odds that a node gives; pair: kind of edge x parent's state x own state.
        """
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = self.x @ w
        belief, to_parent = own.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            m = np.logaddexp(pair[self.edge[level], :, 0] + belief[level, 0:1], pair[self.edge[level], :, 1] + belief[level, 1:2])
            to_parent[level] = m
            np.add.at(belief, self.parent[level], m)
        full, joint = belief.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            rest = full[self.parent[level]] - to_parent[level]
            both = rest[:, :, None] + pair[self.edge[level]] + belief[level][:, None, :]
            from_parent = np.logaddexp(both[:, 0], both[:, 1])
            full[level] = from_parent
            top = both.reshape(-1, 4).max(axis=1)[:, None, None]
            joint[level] = np.exp(both - top)
            joint[level] /= joint[level].sum(axis=(1, 2), keepdims=True)
        z = np.logaddexp(full[:, 0], full[:, 1])
        return np.exp(full[:, 1] - z), joint, z[self.levels[0]] if self.levels else np.zeros(0)


@dataclass
class Model:
    w: np.ndarray
    pair: np.ndarray


def fit(pages: list[str], steps: int = 150, ridge: float = 1e-3) -> Model:
    """Potentials of highest likelihood, by gradient steps (Adam) on the exact expectations; labels come from the article elements."""
    w, pair = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    forest = Forest.of([p for p in pages if re.search(r"<article\b", p, re.I)])
    if not len(forest.parent):
        return Model(w, pair)
    y = forest.under.astype(np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    n = len(y)
    theta = np.zeros(N_FEATURES + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p, joint, _ = forest.marginals(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))
        expected = np.stack([joint[child][forest.edge[child] == k].sum(axis=0) for k in (0, 1)])
        g = np.concatenate((forest.x.T @ (y - p), (seen - expected).reshape(-1))) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))


def train(pages: DataFrame, n_pages: int = 200) -> Model:
    """A model fitted on the n_pages labelled pages (those with an article element) whose page_id has the least hash; n_pages bounds what goes to the driver."""
    labelled = pages.where("html is not null and lower(html) like '%<article%'").select("html", F.xxhash64("page_id").alias("h"))
    # Thinned by hash first, so that what the tasks send does not grow with their number.
    share = min(1.0, 2.0 * (n_pages + 50) / max(1, labelled.count()))
    rows = labelled.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).orderBy("h", "html").limit(n_pages).collect()
    return fit([r.html for r in rows])


def content_of(pages: list[str], model: Model, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(text, text nodes, content nodes, mean marginal of the content nodes) of each page."""
    forest = Forest.of(pages)
    p, _, _ = forest.marginals(model.w, model.pair)
    out: list[list] = [[[], 0, 0, 0.0] for _ in pages]
    for k, t, tag, a, q in zip(forest.page.tolist(), forest.text, forest.name, forest.parent.tolist(), p.tolist()):
        row = out[k]
        if t is None:
            if tag in _BLOCK:
                row[0].append("\n")
            continue
        row[1] += 1
        if q >= least:
            row[0].append(t)
            row[2] += 1
            row[3] += q
    done = []
    for parts, n, kept, total in out:
        lines = (" ".join(line.split()) for line in entities.unescape("".join(parts)).split("\n"))
        done.append(("\n".join(x for x in lines if x), n, kept, total / kept if kept else 0.0))
    return done


def extract(pages: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """(page_id, text, n_text, n_content, marginal) for every row of pages (page_id, html).

    Every DOM node is content or not; its features give a potential, and each parent-child pair another. Messages
    from the leaves to the root and back give each node's exact marginal; text nodes of at least least are the text.

    Edge cases: a null or empty html has an empty text and no nodes; without labelled pages all potentials are even
    and all visible text is content (a marginal of 0.5 counts); repeated rows are each returned; an empty table
    gives an empty result; other columns are ignored; text outside any tag belongs to the root.
    """
    model = model or train(pages)

    def run(batches):
        for batch in batches:
            for part in simhash.chunks(batch, "html", 1 << 20):
                rows = content_of([h or "" for h in part.column(1).to_pylist()], model, least)
                text, n, kept, p = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32()), pa.array(p, pa.float64())], ["page_id", "text", "n_text", "n_content", "marginal"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, text string, n_text int, n_content int, marginal double")
