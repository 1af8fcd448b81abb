"""Main text of web pages by a tree-structured graphical model.

Elements and text blocks of a page are nodes of a tree; each is content or not. Features of a node give its own
potential, and each link between parent and child has a potential that depends on what the child is. Messages upward
and downward (sum-product) give exact marginals; the blocks that are more likely content than not are the main text.
The potentials are trained by gradient on the likelihood of labelled pages, with expected counts from the same messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-y|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SELF_CLOSED = re.compile(r"(?:^|[\s\"']|^[^=]+)/\s*\Z")  # a slash that does not belong to an unquoted value
_NAME_PARTS = re.compile(r"[a-z]+")

GROUPS = {
    "root": "html body", "head": "head", "article": "article main", "nav": "nav menu", "aside": "aside", "header": "header hgroup", "footer": "footer address",
    "form": "form fieldset button select option label textarea legend input dialog", "division": "div section center ins details summary", "list": "ul ol dl", "item": "li dt dd",
    "paragraph": "p", "heading": "h1 h2 h3 h4 h5 h6", "table": "table thead tbody tfoot tr td th caption", "quote": "blockquote pre figure figcaption",
}
_GROUP = {tag: name for name, tags in GROUPS.items() for tag in tags.split()}
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that are skipped with what they hold, and those that may stand in a head.
SKIPPED = frozenset("noscript template svg iframe object canvas title".split())
IN_HEAD = frozenset("title meta link base noscript template basefont bgsound".split())
# An opening tag ends open elements of these kinds, up to the nearest of the second set.
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}),
           "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
HINTS_OFF = frozenset(("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead "
                       "footer copyright legal sidebar widget aside related recommended trending popular teaser cookie cookies consent gdpr notice notification alert popup modal overlay paywall "
                       "comment comments commentlist discussion responses reply replies respond form search login signup signin register subscribe subscription newsletter share sharing social "
                       "tags tag meta byline toolbar skip hidden disclaimer complementary contentinfo dialog").split())
HINTS_ON = frozenset("article content main post entry story body text page maincontent articlebody prose".split())
FEATURES = ["element", "block", *(f"tag:{g}" for g in (*GROUPS, "other")), *(f"in:{g}" for g in (*GROUPS, "other")), "off", "on", "no hint", "hidden", "element:links", "element:text", "element:long", "element:paragraphs",
            "block:links", "block:short", "block:middle", "block:long", "block:sentence", "block:sign"]
_FEATURE = {name: k for k, name in enumerate(FEATURES)}
EDGES = ["block", "plain", "off", "on", "tag off", "tag on"]


@dataclass
class Page:
    """Nodes in page order (parents first). ``text`` is None for elements."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    edge: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


def _named(m: re.Match) -> tuple[str, bool]:
    """Name of a tag in lower case (empty for comments, scripts and styles), and if it is an end tag."""
    return (m[3] or m[6] or "").lower(), (m[2] or m[5]) == "/"


def _unended(m: re.Match) -> bool:
    """A comment, script or style that goes on to the end of the page."""
    return m[0].startswith("<!--") and not m[0][4:].endswith("-->") or bool(m[1]) and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)


def skipped(html: str, tokens: list[re.Match]) -> dict[int, int]:
    """Tokens that begin a skipped part, and the last token of the part.

    Elements without an end tag lose only their tag. A head ends at its end tag or, if none comes before, at the first
    text or element that cannot stand in a head.
    """
    open_: dict[str, list[int]] = {}
    last: dict[int, int] = {}
    heads = []
    for k, m in enumerate(tokens):
        tag, closing = _named(m)
        if tag == "head" and not closing:
            heads.append(k)
        elif tag in SKIPPED:
            if closing:
                if open_.get(tag):
                    last[open_[tag].pop()] = k
            elif not _SELF_CLOSED.search(m[4] or m[7] or ""):
                open_.setdefault(tag, []).append(k)
    for head in heads:
        k, before_text = head, None
        while True:
            begin, k = tokens[k].end(), k + 1
            if before_text is None and html[begin: tokens[k].start() if k < len(tokens) else len(html)].strip():
                before_text = k - 1
            tag, closing = _named(tokens[k]) if k < len(tokens) else ("body", False)
            if closing and tag == "head":
                last[head] = k
                break
            if tag and (tag not in IN_HEAD and not closing or tag in ("body", "html")):
                last[head] = k - 1 if before_text is None else before_text
                break
            k = last.get(k, k)
    return last


def parse(html: str) -> Page:
    """Nodes with their features. Tolerates unclosed and stray tags; scripts, styles, comments and the head give nothing."""
    page, tags, paragraphs, chars, linked, ends = Page(), [], [], [], [], []
    open_: list[int] = []
    places: dict[str, list[int]] = {}  # of open elements by name
    inline = 0  # depth of open links
    run: list[str] = []
    run_linked = 0

    def add(tag: str, attributes: str) -> None:
        named = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        parts = set(_NAME_PARTS.findall(f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}")) if named else set()
        group = _GROUP.get(tag, "other")
        off, on = not parts.isdisjoint(HINTS_OFF), not parts.isdisjoint(HINTS_ON)
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        up = open_[-1] if open_ else -1
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1 if open_ else 0)
        kind = "off" if off else "on" if on else "tag off" if group in ("nav", "aside", "header", "footer", "form", "head") else "tag on" if group == "article" else "plain"
        page.edge.append(EDGES.index(kind))
        page.features.append([_FEATURE["element"], _FEATURE[f"tag:{group}"], _FEATURE["off" if off else "on" if on else "no hint"]] + [_FEATURE["hidden"]] * hidden)
        page.text.append(None)
        mark = named.get("data-y")
        page.label.append(int(mark) if mark else page.label[up] if open_ else 0)
        tags.append(tag)
        chars.append(0)
        linked.append(0)
        paragraphs.append(int(tag == "p"))
        enter(len(tags) - 1)

    def enter(node: int) -> None:
        places.setdefault(tags[node], []).append(len(open_))
        open_.append(node)

    def shut(place: int) -> None:
        """Close the open elements from a place on."""
        while len(open_) > place:
            places[tags[open_.pop()]].pop()

    def nearest(names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, -1 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def in_body() -> None:
        """Pages without html or body tags get them, so that every page has the same root."""
        for tag in ("html", "body"):
            if tag not in tags[:2]:
                add(tag, "")
        if not open_:
            enter(1)

    def flush() -> None:
        """End the block that inline text has been gathered for."""
        nonlocal run_linked
        text = " ".join("".join(run).split())
        run.clear()
        links, run_linked = run_linked, 0
        if not text:
            return
        in_body()
        up, size = open_[-1], len(text)
        page.parent.append(up)
        page.depth.append(page.depth[up] + 1)
        page.edge.append(0)
        got = ["block", f"in:{_GROUP.get(tags[up], 'other')}", "block:short" if size < 40 else "block:middle" if size < 150 else "block:long"]
        got += ["block:links"] * (2 * links > size) + ["block:sentence"] * (text[-1] in ".!?…") + ["block:sign"] * ("©" in text)
        page.features.append([_FEATURE[n] for n in got])
        page.text.append(text)
        page.label.append(page.label[up])
        tags.append("#")
        chars.append(size)
        linked.append(min(links, size))
        paragraphs.append(0)

    def say(text: str) -> None:
        nonlocal run_linked
        run.append(unescape(text) if "&" in text else text)
        if inline:
            run_linked += len(run[-1].strip())

    at = 0
    # Nothing after the last ">" can be a tag, and a comment that begins there takes the rest.
    end = html.rfind(">") + 1
    if (comment := html.find("<!--", end)) >= 0:
        html = html[:comment]
    tokens = list(_TOKEN.finditer(html, 0, end))
    if tokens and tokens[-1].end() == end and _unended(tokens[-1]):
        html = html[:end]
    last = skipped(html, tokens)
    for k, m in enumerate(tokens):
        if m.start() < at:
            continue
        if m.start() > at:
            say(html[at: m.start()])
        at = tokens[last[k]].end() if k in last else m.end()
        tag, closing = _named(m)
        if not tag or k in last:
            continue
        attributes = m[4] or m[7] or ""
        if tag == "br" or tag == "wbr":
            run.append(" " if tag == "br" else "")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag not in _GROUP:
            if tag == "a":
                inline = max(0, inline + (-1 if closing else 1))
        elif closing:
            flush()
            inline = 0
            if places.get(tag):
                shut(places[tag][-1])
        else:
            flush()
            inline = 0
            if open_ and tags[open_[-1]] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                shut(len(open_) - 1)
            if tag in _CLOSES:
                ended, fence = _CLOSES[tag]
                place = nearest(ended.split())
                if place > nearest(fence):
                    shut(place)
            if tag == "html" and not tags or tag == "body" and tags == ["html"]:
                add(tag, attributes)
            elif tag not in ("html", "body"):
                in_body()
                add(tag, attributes)
    if at < len(html):
        say(html[at:])
    flush()
    for k in range(len(tags) - 1, -1, -1):
        up = page.parent[k]
        if page.text[k] is None:
            got = ["element:links"] * (2 * linked[k] > chars[k]) + ["element:text"] * (chars[k] > 0) + ["element:long"] * (chars[k] > 400) + ["element:paragraphs"] * (paragraphs[k] > 1)
            page.features[k] += [_FEATURE[n] for n in got]
        if up >= 0:
            chars[up] += chars[k]
            linked[up] += linked[k]
            paragraphs[up] += tags[k] == "p"
    return page


@dataclass
class Forest:
    """Nodes of many pages as arrays."""

    parent: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]  # nodes by depth
    node_of: np.ndarray  # active features: their nodes
    feature: np.ndarray
    label: np.ndarray

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        size = np.array([len(p.parent) for p in pages], np.int64)
        shift = np.repeat(np.cumsum(size) - size, size)
        parent = np.array([x for p in pages for x in p.parent], np.int64)
        depth = np.array([x for p in pages for x in p.depth], np.int64)
        many = [x for p in pages for x in p.features]
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        return Forest(np.where(parent >= 0, parent + shift, -1), np.array([x for p in pages for x in p.edge], np.int64), levels,
                      np.repeat(np.arange(len(many)), [len(x) for x in many]), np.array([f for x in many for f in x], np.int64), np.array([x for p in pages for x in p.label], np.int64))


@dataclass
class Potentials:
    node: np.ndarray  # per feature: score of being content
    link: np.ndarray  # per kind of child: 2 x 2 scores by label of parent and child

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content for each node, and of each pair of labels (parent, child) for each node with a parent."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(forest.node_of, weights=self.node[forest.feature], minlength=n)
        links = self.link[forest.edge]
        below = own.copy()  # own score and messages of the children
        up = np.zeros((n, 2))
        for level in forest.levels[:0:-1]:
            message = np.logaddexp(below[level, None, 0] + links[level, :, 0], below[level, None, 1] + links[level, :, 1])
            up[level] = message
            np.add.at(below, forest.parent[level], message)
        above = np.zeros((n, 2))  # message of the parent
        pairs = np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            p = forest.parent[level]
            rest = below[p] + above[p] - up[level]
            above[level] = np.logaddexp(rest[:, 0, None] + links[level, 0], rest[:, 1, None] + links[level, 1])
            joint = rest[:, :, None] + links[level] + below[level, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief = below + above
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


#: Labelled pages that training reads at most; more teach these few potentials nothing and would only cost time on the driver.
TRAINING_PAGES = 2000


def train(pages: list[str], rounds: int = 250, rate: float = 0.1, shrink: float = 1e-3) -> Potentials:
    """Potentials from pages labelled by ``data-y``: gradient ascent on the likelihood of the labels."""
    forest = Forest.of([parse(p) for p in pages[:TRAINING_PAGES]])
    child = np.flatnonzero(forest.parent >= 0)
    real = np.zeros((len(EDGES), 2, 2))
    np.add.at(real, (forest.edge[child], forest.label[forest.parent[child]], forest.label[child]), 1)
    seen = np.bincount(forest.feature, weights=forest.label[forest.node_of], minlength=len(FEATURES))
    found = Potentials(np.zeros(len(FEATURES)), np.zeros((len(EDGES), 2, 2)))
    steps = [np.zeros_like(found.node), np.zeros_like(found.link)], [np.zeros_like(found.node), np.zeros_like(found.link)]
    for t in range(1, rounds + 1):
        content, pairs = found.marginals(forest)
        expected = np.zeros_like(real)
        np.add.at(expected, forest.edge[child], pairs[child])
        slopes = (seen - np.bincount(forest.feature, weights=content[forest.node_of], minlength=len(FEATURES))) / len(pages) - shrink * found.node, (real - expected) / len(pages) - shrink * found.link
        for k, (value, slope) in enumerate(zip((found.node, found.link), slopes)):
            steps[0][k][:] = 0.9 * steps[0][k] + 0.1 * slope
            steps[1][k][:] = 0.99 * steps[1][k] + 0.01 * slope * slope
            value += rate * (steps[0][k] / (1 - 0.9**t)) / (np.sqrt(steps[1][k] / (1 - 0.99**t)) + 1e-8)
    return found


def extract_all(htmls: list[str], potentials: Potentials) -> list[str]:
    """Main text of each page: its content blocks in page order, one per line."""
    pages = [parse(h) for h in htmls]
    content, _ = potentials.marginals(Forest.of(pages))
    out, at = [], 0
    for p in pages:
        likely = content[at: at + len(p.text)]
        at += len(p.text)
        out.append("\n".join(t for t, c in zip(p.text, likely) if t is not None and c >= 0.5))
    return out


def extract(pages: DataFrame, potentials: Potentials, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the ``keep`` columns, ``text`` (empty if there is none) and ``n_chars``. Null html is empty.

    Repeated rows stay and get equal texts; other columns are not looked at.
    """
    base.small_batches(pages.sparkSession, 200)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract_all(batch.column("html").to_pylist(), potentials)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in keep}, "text": pa.array(texts, pa.string())})

    rows = pages.select(*keep, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n in keep) + ", text string"
    return rows.mapInArrow(task, schema).withColumn("n_chars", F.length("text").cast("long"))
