"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at its block-level tags. A block is described by
its own word count and link density, those of its neighbours, and, as minor
features, what encloses it; a decision tree, trained on the small table of
labelled blocks that layouts.pages() gives, keeps or drops it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import layouts

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements whose content is no text of the page (fixed values).
_SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "math", "audio", "video"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img br input".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = {"nav", "footer", "aside", "button", "select", "dialog", "menu", "fieldset", "head"}
#: Parts of class, id and role names that mark adverts, menus, comments and the like (fixed values).
_STRONG_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments commentlist disqus reply replies cookie cookies consent gdpr sponsor sponsored newsletter signup login popup modal overlay pagination pager copyright "
    "complementary contentinfo".split()
)
#: Of these, the names of adverts: inline elements with one are no text, as hidden ones are none.
_ADVERT_NAMES = {x for x in _STRONG_NAMES if x.startswith(("ad", "sponsor"))}
#: Names that often mark such parts, and often main text too (fixed values).
_WEAK_NAMES = set("notice notices notification alert promo promotion share sharing social related recommended recommendations subscribe subscription widget toolbar legal disclaimer search form".split())
#: Beginnings and ends of names that tell what a page has or how it stands, not what an element is (fixed values).
_STATES = ("has-", "has_", "no-", "no_", "with-", "with_", "is-", "is_", "not-")
_STATE_ENDS = tuple(
    f"{sign}{end}" for sign in "-_" for end in "free less closed close open opened enabled disabled active inactive visible hidden ready loaded fixed on off collapsed expanded shown yes no true false".split()
)
#: How a notice of rights begins or ends (fixed values), in a block of NOTICE_WORDS words or fewer outside an article.
_NOTICE = re.compile(r"^(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4}))|\ball rights reserved\.?$", re.I)
NOTICE_WORDS = 40
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Pages of each layout in the table that the tree is trained on.
TRAINED_PAGES = 24
#: What a block is described by.
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "tag", "name", "name outside the article", "article")


@dataclass
class Node:
    """A test 'feature <= threshold', or a leaf with its verdict."""

    keep: bool
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def verdict(self, x: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.threshold else node.high
        return node.keep


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> Node:
    """A decision tree by Gini impurity; among equal splits the first feature and least threshold."""
    node = Node(bool(labels.mean() >= 0.5))
    if depth == 0 or labels.min() == labels.max():
        return node
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= t
            cost = sum(y.size * y.mean() * (1 - y.mean()) for y in (labels[low], labels[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t)
    if best is None:
        return node
    _, node.feature, node.threshold = best
    low = rows[:, node.feature] <= node.threshold
    node.low, node.high = grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)
    return node


def labelled_blocks(made: list[tuple[str, list[tuple[str, bool]]]]) -> list[tuple]:
    """(features.., main text) of the blocks of labelled pages."""
    out = []
    for page, labelled in made:
        found = blocks(page)
        label = dict(labelled)
        out += [(*x, label[b[0]]) for b, x in zip(found, described(found)) if b[0] in label]
    return out


def train(labelled: list[tuple] | None = None) -> Node:
    """The tree of a table of labelled blocks; without one, of TRAINED_PAGES pages of each layout."""
    table = np.array(labelled or labelled_blocks(layouts.pages(1, TRAINED_PAGES)), float)
    return grow(table[:, :-1], table[:, -1])


def _names(attributes: str) -> tuple[set[str], bool]:
    """Parts of class, id and role names, and whether the element is hidden."""
    parts: set[str] = set()
    hidden = False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                if not token.startswith(_STATES) and not token.endswith(_STATE_ENDS):
                    parts.update(_SPLIT.split(token))
        hidden |= name == "hidden" or (name == "style" and "display:none" in value.replace(" ", ""))
    return parts, hidden


def blocks(page: str) -> list[tuple[str, int, int, bool, int, int, bool]]:
    """(text, words, linked words, tag, name, name outside, article) of the flat blocks of a page, in order.

    tag: a menu, footer, side or hidden element is around; name: the strongest
    name (1 weak, 2 strong) around it inside the innermost article; name
    outside: the strongest one around that; article: one is around.
    """
    out: list[tuple[str, int, int, bool, int, int, bool]] = []
    plain = (False, 0, 0, False)
    in_forms: list[bool] = []  # of each block, whether a form is around it
    stack: list[tuple[str, tuple[bool, int, int, bool]]] = []  # open block elements with what is around their content
    pieces: list[str] = []
    linked, in_link = 0, False
    unclosed: set[str] = set()  # inline elements of which one was never closed

    def end_of(name: str, at: int) -> int:
        """The end of an inline element that began before at; at itself if it is never closed."""
        depth = 1
        for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
            depth += -1 if m[1] else 1
            if not depth:
                return m.end()
        unclosed.add(name)
        return at

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            words = text.count(" ") + 1
            tag, strength, outside, article = stack[-1][1] if stack else plain
            if not article and words <= NOTICE_WORDS and _NOTICE.search(text):
                strength = 2
            out.append((text, words, min(linked, words), tag, strength, outside, article))
            in_forms.append(any(name == "form" for name, _ in stack))
        linked = 0

    def text(part: str) -> None:
        nonlocal linked
        if part:
            pieces.append(part)
            if in_link:
                linked += len(part.split())

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if name in _SKIPPED:
            if not close and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, at)
                at = stop.end()
            if name not in ("svg", "math"):
                flush()
            continue
        if name == "a":
            in_link = not close
        if name == "br":
            pieces.append(" ")
        if name in _INLINE:
            if attributes and not close and name not in _VOID and name not in unclosed:
                names, hidden = _names(attributes)
                if hidden or names & _ADVERT_NAMES:
                    at = end_of(name, at)
                    pieces.append(" ")
            continue
        flush()
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            if name != "a":
                in_link = False
            continue
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"))):
            stack.pop()
        if name in _VOID:
            continue
        tag, strength, outside, article = stack[-1][1] if stack else plain
        names, hidden = _names(attributes) if attributes else (set(), False)
        top = name in ("html", "body")
        if not top and (name in ("article", "main") or names & {"main", "articlebody", "article"}):
            article, outside, strength = True, max(outside, strength), 0
        if not top and name != "main":
            strength = max(strength, 2 if names & _STRONG_NAMES else 1 if names & _WEAK_NAMES else 0)
        header = not article and (name == "header" or ("header" in names and not top))
        stack.append((name, (tag or name in _BOILER_TAGS or hidden or header, strength, outside, article)))
    flush()
    # A form counts as a weak name, but not one around most of the page's words.
    inside = sum(b[1] for b, form in zip(out, in_forms) if form)
    if 2 * inside <= sum(b[1] for b in out):
        out = [(*b[:4], max(b[4], 1), *b[5:]) if form else b for b, form in zip(out, in_forms)]
    return out


def described(found: list[tuple]) -> list[tuple]:
    """The FEATURES of each block of a page."""
    shape = [(0, 0.0)] + [(b[1], b[2] / b[1]) for b in found] + [(0, 0.0)]
    return [(*shape[k], *shape[k - 1], *shape[k + 1], *b[3:]) for k, b in enumerate(found, 1)]


def main_text(page: str | None, tree: Node) -> str:
    """The kept blocks joined by line breaks; empty for a null or blank page."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, x in zip(found, described(found)) if tree.verdict(x))


def _extract(tree: Node, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
        keep = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"]
        )


def extract(pages: DataFrame, keys: list[str], html_column: str = "html", labelled: list[tuple] | None = None) -> DataFrame:
    """The columns keys of each page with text (its main text) and n_chars (its code points).

    A null or blank page, and one without main text, has an empty text. Very
    long pages are read whole. Repeated rows are extracted each, equal blocks
    of a page too; other columns, also such named text or n_chars, go; an empty
    table gives an empty one.
    """
    tree = train(labelled)
    rows = pages.select(*keys, F.col(html_column).alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return rows.mapInArrow(lambda it: _extract(tree, it), f"{schema}, text string, n_chars long")
