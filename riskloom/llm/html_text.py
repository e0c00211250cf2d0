"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its word count and link density, those of
its neighbours, what its tag path says (inside the article, marked by a class or a header as something else, beside an article) and
whether it is a heading. A decision tree, trained with numpy on the small labelled table below, keeps or drops each block;
kept blocks are joined in page order. Menus inside an article, whose short link lines stand side by side, go by their neighbours.

Contents of scripts, styles, forms, menus, footers, asides and other elements that never hold the article never become blocks, nor do
comments and hidden elements. Character references are decoded once, after tags are gone.

Defined cases: null or empty html gives an empty text; malformed markup is read as it stands (unclosed tags end with their
container, but a script, style, textarea or title holds all up to its closing tag; a stray ``<`` is text); rows that repeat stay; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import for_python

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^a-z0-9]+")

#: Elements whose content isn't text of the page.
SKIPPED = frozenset("script style noscript template title svg math iframe object canvas select textarea button audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and ARIA roles whose content never becomes a block.
FURNITURE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of a class or id that mark a block; the mark is one of the tree's inputs.
HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer "
                  "header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted "
                  "recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription "
                  "toolbar widget".split())
#: Elements whose content has no tags.
RAW = frozenset("script style textarea title".split())
CONTAINERS = frozenset("article main section div ul ol li dl table tbody thead tr td th body figure blockquote details p pre header".split()) | FURNITURE

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "marked", "beside", "heading")
#: What the tag path of a block says: nothing, inside the article, marked by a class, id or header, never a block.
PLAIN, ARTICLE, MARKED, GONE = 0, 1, 2, 3

# Labelled blocks to learn from, by tag path: words, link density, both of the block before and of the block after, heading, and 1
# for main text. "beside" is a block without a mark on a page that has an article elsewhere, "plain" one on a page without.
LABELLED = {
    "article": (
        # paragraphs and headings, long and short, with and without links
        (60, 0.0, 8, 0.0, 55, 0.0, 0, 1), (3, 0.0, 40, 0.0, 60, 0.0, 0, 1), (1, 0.0, 20, 0.0, 30, 0.0, 0, 1), (8, 0.0, 6, 1.0, 45, 0.0, 1, 1),
        (5, 0.0, 70, 0.0, 80, 0.0, 1, 1), (2, 0.0, 0, 0.0, 12, 0.0, 1, 1), (120, 0.1, 35, 0.0, 20, 0.0, 0, 1), (30, 0.4, 50, 0.0, 40, 0.0, 0, 1),
        (45, 0.0, 30, 0.0, 9, 0.5, 0, 1), (15, 0.0, 10, 0.0, 3, 1.0, 0, 1), (4, 0.0, 4, 0.0, 4, 0.0, 0, 1), (9, 0.2, 8, 0.2, 7, 0.2, 0, 1),
        (200, 0.0, 0, 0.0, 0, 0.0, 0, 1), (20, 0.0, 3, 1.0, 4, 1.0, 0, 1), (2, 0.0, 1, 1.0, 1, 1.0, 0, 1), (6, 0.0, 2, 1.0, 0, 0.0, 0, 1),
        (3, 0.0, 0, 0.0, 2, 1.0, 0, 1), (5, 0.0, 4, 1.0, 3, 1.0, 1, 1), (2, 0.0, 2, 1.0, 3, 1.0, 1, 1), (7, 0.5, 3, 1.0, 2, 1.0, 0, 1),
        (10, 0.4, 4, 1.0, 40, 0.0, 0, 1), (3, 0.6, 2, 1.0, 2, 1.0, 0, 1),
        # linked lines between running text: a source, a single reference
        (12, 0.9, 40, 0.0, 35, 0.0, 0, 1), (6, 1.0, 25, 0.0, 30, 0.0, 0, 1), (1, 1.0, 12, 0.0, 15, 0.1, 0, 1), (3, 0.8, 60, 0.2, 0, 0.0, 0, 1),
        (2, 1.0, 0, 0.0, 50, 0.0, 0, 1), (4, 1.0, 5, 0.5, 8, 0.4, 0, 1), (1, 1.0, 0, 0.0, 0, 0.0, 0, 1), (9, 1.0, 3, 0.0, 4, 0.0, 0, 1),
        (5, 0.8, 30, 0.5, 6, 0.6, 0, 1), (2, 1.0, 2, 0.6, 3, 0.5, 0, 1),
        # linked headings, and long linked lines beside others
        (5, 1.0, 4, 1.0, 6, 1.0, 1, 1), (3, 1.0, 20, 0.0, 2, 1.0, 1, 1), (4, 0.8, 2, 1.0, 30, 0.0, 1, 1), (2, 1.0, 3, 1.0, 2, 1.0, 1, 1),
        (30, 0.9, 20, 0.9, 15, 1.0, 0, 1), (16, 1.0, 18, 1.0, 30, 0.0, 0, 1), (15, 0.8, 40, 0.0, 22, 1.0, 0, 1), (60, 1.0, 3, 1.0, 2, 1.0, 0, 1),
        # menus: short linked lines side by side, the first, the inner and the last ones
        (3, 1.0, 2, 1.0, 3, 1.0, 0, 0), (4, 0.8, 3, 1.0, 2, 1.0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (2, 1.0, 45, 0.0, 3, 1.0, 0, 0),
        (5, 1.0, 30, 0.1, 4, 0.8, 0, 0), (3, 1.0, 4, 1.0, 60, 0.0, 0, 0), (1, 1.0, 2, 0.8, 8, 0.0, 0, 0), (7, 0.8, 6, 1.0, 0, 0.0, 0, 0),
        (13, 1.0, 10, 1.0, 12, 1.0, 0, 0), (9, 0.8, 0, 0.0, 9, 0.9, 0, 0), (12, 0.9, 11, 0.8, 70, 0.0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0),
        (2, 1.0, 14, 1.0, 13, 0.8, 0, 0), (10, 1.0, 100, 0.0, 1, 1.0, 0, 0)),
    "marked": (
        # adverts, notices, sidebars, site headers, readers' comments, short and long
        (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 0), (25, 0.0, 4, 1.0, 60, 0.0, 0, 0),
        (80, 0.0, 50, 0.0, 70, 0.0, 0, 0), (7, 0.0, 45, 0.0, 0, 0.0, 0, 0), (3, 0.0, 10, 0.0, 90, 0.0, 1, 0), (40, 0.3, 90, 0.0, 10, 0.8, 0, 0),
        (150, 0.0, 30, 0.0, 40, 0.0, 0, 0), (14, 0.6, 6, 1.0, 5, 1.0, 0, 0), (1, 0.0, 60, 0.0, 1, 1.0, 0, 0), (5, 0.0, 0, 0.0, 30, 0.0, 1, 0)),
    "beside": (
        # site titles, unmarked notices and remarks, links to other pages
        (2, 0.0, 0, 0.0, 8, 0.0, 1, 0), (6, 0.0, 3, 1.0, 40, 0.0, 1, 0), (12, 0.0, 60, 0.0, 30, 0.0, 0, 0), (45, 0.0, 80, 0.0, 25, 0.0, 0, 0),
        (3, 1.0, 2, 1.0, 4, 1.0, 0, 0), (90, 0.0, 0, 0.0, 50, 0.0, 0, 0), (8, 0.4, 70, 0.0, 0, 0.0, 0, 0), (20, 0.9, 5, 0.0, 6, 1.0, 0, 0)),
    "plain": (
        # running text beside running text, headings of such text, link lists
        (50, 0.0, 40, 0.0, 60, 0.0, 0, 1), (25, 0.05, 7, 0.0, 40, 0.0, 0, 1), (35, 0.2, 60, 0.0, 2, 1.0, 0, 1), (18, 0.0, 45, 0.0, 30, 0.0, 0, 1),
        (12, 0.0, 30, 0.0, 25, 0.0, 0, 1), (70, 0.0, 0, 0.0, 0, 0.0, 0, 1), (6, 0.0, 40, 0.0, 55, 0.0, 1, 1), (7, 0.0, 2, 1.0, 50, 0.0, 1, 1),
        (4, 0.0, 60, 0.0, 40, 0.0, 0, 1), (90, 0.25, 1, 1.0, 50, 0.0, 0, 1), (5, 0.0, 30, 0.1, 45, 0.0, 0, 1), (11, 0.0, 6, 0.0, 35, 0.0, 0, 1),
        (4, 0.0, 2, 1.0, 20, 0.0, 1, 1), (3, 0.0, 1, 1.0, 45, 0.0, 1, 1), (18, 0.0, 25, 0.0, 2, 1.0, 0, 1), (14, 0.0, 20, 0.0, 1, 1.0, 0, 1),
        (25, 0.1, 40, 0.0, 3, 1.0, 0, 1), (5, 0.0, 4, 1.0, 30, 0.0, 1, 1), (6, 0.0, 3, 1.0, 25, 0.0, 1, 1),
        (2, 1.0, 2, 1.0, 3, 1.0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (6, 0.8, 3, 1.0, 4, 1.0, 0, 0), (30, 0.9, 20, 0.9, 15, 1.0, 0, 0),
        (4, 0.0, 2, 1.0, 3, 1.0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0), (8, 0.7, 50, 0.0, 2, 1.0, 0, 0), (6, 0.0, 2, 1.0, 0, 0.0, 0, 0),
        (5, 1.0, 40, 0.0, 45, 0.0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0), (15, 0.6, 4, 1.0, 60, 0.0, 0, 0), (2, 0.0, 2, 1.0, 3, 1.0, 1, 0)),
}


def labelled() -> np.ndarray:
    """The labelled table as numbers: FEATURES, then 1 for main text."""
    return np.array([(*r[:6], path == "article", path == "marked", path == "beside", *r[6:]) for path, rows in LABELLED.items() for r in rows], float)


@lru_cache(1)
def tree(min_gain: float = 1e-9) -> tuple:
    """Nested (feature, threshold, low side, high side); leaves are booleans. Greedy splits by Gini impurity."""
    data = labelled()

    def gini(y: np.ndarray) -> float:
        return len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def grow(rows: np.ndarray):
        y, best = rows[:, -1], None
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] <= cut
                gain = gini(y) - gini(y[low]) - gini(y[~low])
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut, low)
        if best is None or best[0] <= min_gain:
            return bool(y.mean() >= 0.5)
        return best[1], best[2], grow(rows[best[3]]), grow(rows[~best[3]])
    return grow(data)


def classify(features: np.ndarray, node=None) -> np.ndarray:
    node = tree() if node is None else node
    if isinstance(node, bool):
        return np.full(len(features), node)
    low = features[:, node[0]] <= node[1]
    out = np.empty(len(features), bool)
    out[low], out[~low] = classify(features[low], node[2]), classify(features[~low], node[3])
    return out


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def blocks(page: str | None) -> list[tuple[str, int, int, bool]]:
    """(text, words in links, what the tag path says, heading) of each text block of a page, in order."""
    page = page or ""
    out: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # container, what the path down to it says, hidden
    parts: list[tuple[str, bool]] = []
    inner: list[str] = []  # containers opened in the element that is skipped
    link, heading, skip, depth, at, seen_article = False, "", "", 0, 0, False

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if text and not (stack and stack[-1][2]):
                linked = sum(len(entities.unescape(p).split()) for p, in_link in parts if in_link)
                where = stack[-1][1] if stack else PLAIN
                if heading and where == MARKED and stack[-1][0] == "header" and any(s[1] == ARTICLE for s in stack):
                    where = ARTICLE  # the article's own title
                if where != GONE:
                    out.append((text, linked, where, bool(heading)))
            parts.clear()

    for m in _TOKEN.finditer(page):
        if not skip and m.start() > at:
            parts.append((page[at:m.start()], link))
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if not skip and m[0].startswith("<![CDATA["):
                parts.append((entities.escape(m[0][9:].removesuffix("]]>")), link))
            continue
        name, closing = name.lower(), bool(m["close"] or m["close2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if attrs.endswith("/") else 1
                if depth <= 0 or closing and skip in RAW:
                    skip = ""
                continue
            if skip in RAW or name not in CONTAINERS:
                continue
            if not closing:
                if not attrs.endswith("/"):
                    inner.append(name)
                continue
            if name in inner:
                while inner.pop() != name:
                    pass
                continue
            if not any(s[0] == name for s in stack):
                continue
            skip = ""  # the container that holds it ends
        if name in SKIPPED:
            if not closing and not (attrs.endswith("/") and name in ("svg", "math")):
                skip, depth, inner = name, 1, []
            continue
        if name == "a":
            link = not closing and "href" in attrs.lower()
            continue
        if name in INLINE:
            continue
        if name == "br":
            parts.append((" ", link))
            continue
        flush()
        link = False
        if name in HEADINGS:
            heading = "" if closing else name
            continue
        heading = ""
        if name not in CONTAINERS or name in VOID:
            continue
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name == "p":  # a paragraph ends the one before
            while stack and stack[-1][0] == "p":
                stack.pop()
        own = _attributes(attrs) if attrs.strip() else {}
        where, hidden = (stack[-1][1], stack[-1][2]) if stack else (PLAIN, False)
        hidden = hidden or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        hinted = name != "body" and not HINTS.isdisjoint(_WORDS.split(f"{own.get('class', '')} {own.get('id', '')}".lower()))
        if name == "main" or own.get("role") == "main":
            where = ARTICLE
        elif name in FURNITURE or own.get("role", "").lower() in ROLES or where == GONE:
            where = GONE
        elif name == "article" and not hinted and (where != MARKED or not seen_article and not any(s[0] == "header" for s in stack)):
            where, seen_article = ARTICLE, True
        elif hinted or name == "header" or own.get("role", "").lower() == "banner":
            where = MARKED
        if not attrs.endswith("/"):
            stack.append((name, where, hidden))
    if not skip and at < len(page):
        parts.append((page[at:], link))
    flush()
    return out


def features(found: list[tuple[str, int, int, bool]]) -> np.ndarray:
    words = np.array([len(t.split()) for t, *_ in found], float)
    density = np.array([x[1] for x in found], float) / np.maximum(words, 1)
    before = lambda v: np.concatenate([[0.0], v[:-1]])
    after = lambda v: np.concatenate([v[1:], [0.0]])
    path = np.array([x[2] for x in found])
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), path == ARTICLE, path == MARKED,
                            (path == PLAIN) & (path == ARTICLE).any(), [x[3] for x in found]])


def main_text(page: str | None) -> str:
    found = blocks(page)
    keep = classify(features(found)) if found else ()
    return " ".join(x[0] for x, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [main_text(h) for h in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]}, index=part.index)
    own = for_python(pages).select(F.col("page_id").cast("long"), "url", "html")
    return own.mapInPandas(run, "page_id long, url string, text string, n_chars long")
