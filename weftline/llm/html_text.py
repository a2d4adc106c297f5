"""Main-text extraction from web pages: flat text blocks judged by a decision tree.

A page is cut into flat blocks at block-level tags, in one pass that reads every character
a bounded number of times. A block has its number of words and its link density (share of
characters in links), those of the blocks before and behind it, whether it stands in the
page's article (of several, the one of most words), outside of it, or in a page without
one, whether an element around it is a menu, footer, form and the like by tag or by class,
id or role, and whether it is a heading. A small CART, grown from features measured on the
labelled pages below (or on the caller's), keeps or drops each block.

Edge cases: null and empty pages give an empty text; tags without ``>`` end where the next
one begins; unclosed elements end where the next block of their kind begins; scripts,
styles, titles and text areas without an end tag go on to the end of the page, as browsers
have it, other elements do not; a self-closed element holds nothing; every page gives one
row, repeats included; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose contents are never text of the page; the first go on to the end of the page if they are not closed.
RAW = frozenset("script style textarea title iframe noscript".split())
UNSEEN = frozenset("svg object video audio canvas select datalist template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of menus and the like; an article inside one of the second kind is an article still.
BOILER = frozenset("nav footer aside menu head".split())
WRAPPER = frozenset("form dialog fieldset header".split())
#: Elements that a new one of the same kind closes.
LEAVES = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 option".split())
#: Whole words of class, id or role: what is meant, with what may stand before and behind it.
BEFORE = r"(?:(?:site|page|global|main|top|bottom|left|right|primary|secondary|sticky|fixed|user|reader|post|article|blog|text|google|inline|js)[-_]+)*"
BEHIND = r"(?:[-_]+(?:bar|box|list|links?|items?|banner|notice|wrap|wrapper|container|area|section|block|panel|content|inner|outer|form|text|unit|slot|body|thread|widget|menu|nav|posts?|articles?|stories|news|media|buttons?|icons?|top|bottom|left|right|\d+))*"
STRONG = re.compile(BEFORE + r"(?:comments?|commentlist|disqus\w*|repl(?:y|ies)|respond|related|recommended|recommendations|sidebar|footer|contentinfo|complementary|nav|navbar|navigation|menu|menubar|breadcrumbs?|pagination|pager)" + BEHIND, re.I)
WEAK = re.compile(
    BEFORE + r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notifications?|alert|popup|modal|dialog|overlay|widgets?|share|sharing|social|newsletter|subscribe|subscription|signup|login|toolbar|search|copyright|skip-?links?)" + BEHIND, re.I
)
TOP = re.compile(r"(?:(?:site|page|global|main|top)[-_]+)*(?:header|masthead)" + BEHIND, re.I)
#: A tag, up to its ``>`` or the next ``<`` outside of quotes; a quote that is never closed is a character like others.
TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "place", "boiler", "heading")


def page_of(parts) -> tuple[str, list[int]]:
    """A labelled page: its html, and for each block 1 for main text.

    Parts are (tag, attributes, blocks, label), blocks (tag, words, words in a link) and, if it is not their part's, a label.
    """
    out, labels = [], []
    for tag, attrs, blocks, label in parts:
        out.append(f"<{tag} {attrs}>")
        for name, words, linked, *own in blocks:
            out.append(f"<{name}><a>{'word ' * linked}</a> {'word ' * (words - linked)}</{name.split()[0]}>")
            labels.append(own[0] if own else label)
        out.append(f"</{tag}>")
    return "".join(out), labels


LINKS, LIST = (("li", 1, 1),) * 5, (("li", 2, 2), ("li", 4, 4), ("li", 3, 3))
PROSE = (("h1", 6, 0), ("p", 40, 0), ("p", 80, 6), ("p", 3, 0), ("p", 1, 0), ("h2", 4, 0), ("p", 120, 0), ("p", 9, 0), ("p", 25, 9), ("p", 60, 0))
SHORT = (("h1", 3, 0), ("p", 8, 0), ("p", 5, 0), ("p", 30, 0), ("p", 7, 0), ("p", 2, 0), ("p", 11, 0), ("p", 4, 0))
TERSE = (("p", 6, 0), ("p", 12, 2), ("p", 9, 0), ("p", 15, 0), ("p", 5, 0))
#: An article may hold blocks of every shape in every order.
ANY = tuple(("p", n, linked) for a in (1, 4, 30) for b in (1, 2, 9) for n, linked in ((a, 0), (b, b), (a, a), (b, 0), (a, a // 2)))
WITHIN = tuple((name, n, linked, 0) for name in ("div class=ad", "aside", "footer", "div class=comments", "form") for n, linked in ((3, 0), (40, 0), (6, 6)))
#: The labelled pages: with an article, without one, of long and short paragraphs, with elements of menus and the like within and around.
LABELLED_PAGES = (
    (("nav", "", LINKS, 0), ("div", "class=ad", (("p", 6, 0),), 0), ("article", "", PROSE, 1), ("footer", "", (("p", 5, 0), ("p", 3, 3)), 0)),
    (("header", "", (("p", 2, 0),), 0), ("ul", "", LINKS, 0), ("article", "", SHORT, 1), ("div", "class=comments", (("p", 30, 0), ("p", 9, 0), ("p", 45, 0)), 0)),
    (("article", "", PROSE[:4], 1), ("aside", "", LIST + (("p", 30, 0),), 0), ("form", "", (("p", 12, 0),), 0)),
    (("div", "", (("p", 4, 0), ("p", 60, 0)), 0), ("article", "", (("p", 1, 0), ("li", 6, 6), ("li", 1, 1), ("p", 90, 0), ("p", 7, 4)), 1), ("div", "", (("p", 40, 0), ("p", 3, 1), ("p", 14, 0)), 0)),
    (("article", "", (("h1", 9, 0), ("p", 2, 2), ("p", 3, 3)), 1), ("ul", "", LIST, 0), ("div", "", (("p", 8, 0),), 0)),
    (("nav", "", LINKS, 0), ("article", "", ANY, 1), ("ul", "", LIST, 0)),
    (("nav", "", LINKS, 0), ("article", "", sum(zip(WITHIN, ANY), ()), 1)),
    (("p", "", (("b", 3, 0),), 0), ("main", "", ANY[::-1], 1), ("div", "class=menu", LINKS, 0)),
    (("main", "", TERSE + PROSE[2:], 1), ("div", "class=sidebar", (("h3", 2, 0),) + LIST + (("p", 70, 0),), 0)),
    (("ul", "", LINKS, 0), ("div", "", PROSE, 1), ("ul", "", LIST, 0), ("div", "class=footer", (("p", 9, 0),), 0)),
    (("ul", "", LINKS, 0), ("div", "", SHORT, 1), ("div", "class=related", (("h3", 2, 0),) + LIST, 0)),
    (("div", "class=cookie-notice", (("p", 14, 1),), 0), ("ul", "", LIST, 0), ("div", "", TERSE, 1), ("ul", "", LINKS, 0)),
    (("div", "", SHORT[1:], 1), ("div", "class=comments", (("p", 40, 0), ("p", 12, 0)), 0)),
    (("div", "", (("p", 50, 0),), 1), ("ul", "", LIST, 0)),
    (("ul", "", LINKS, 0), ("div", "", (("p", 90, 2),), 1)),
    (("div", "", (("p", 30, 3),), 1),),
    (("ul", "", LINKS, 0), ("div", "", (("h1", 5, 0), ("p", 14, 0)), 1), ("ul", "", LIST, 0)),
    (("ul", "", (("li", 1, 1), ("li", 6, 6), ("li", 9, 8), ("li", 2, 2), ("li", 12, 10)), 0), ("div", "", (("p", 22, 5), ("p", 13, 0), ("p", 8, 2)), 1), ("div", "", (("p", 3, 3), ("p", 4, 2)), 0)),
    (("ul", "", LIST, 0), ("div", "", (("p", 3, 0),), 0), ("ul", "", LINKS, 0)),
    (("ul", "", LIST, 0), ("div", "", PROSE[1:], 1), ("ul", "", LINKS, 0), ("div", "", (("p", 4, 0),), 0), ("ul", "", LINKS, 0)),
    (("nav", "", LIST + (("p", 30, 0),), 0), ("div", "", TERSE + SHORT, 1), ("footer", "", (("p", 25, 0), ("p", 60, 0)), 0)),
)


def grow(rows: tuple, depth: int = 8):
    """A CART by Gini impurity: (feature, threshold, left, right), or the leaf's majority label."""
    ones, n = sum(r[-1] for r in rows), len(rows)
    if depth == 0 or ones in (0, n):
        return int(2 * ones >= n)
    gini = lambda part: (lambda p: 2 * p * (1 - p) * len(part))(sum(r[-1] for r in part) / len(part))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            t = (low + high) / 2
            left, right = [r for r in rows if r[f] <= t], [r for r in rows if r[f] > t]
            if best is None or gini(left) + gini(right) < best[0] - 1e-12:
                best = (gini(left) + gini(right), f, t, left, right)
    if best is None:
        return int(2 * ones >= n)
    return best[1], best[2], grow(tuple(best[3]), depth - 1), grow(tuple(best[4]), depth - 1)


def measured(pages=LABELLED_PAGES) -> tuple:
    """The labelled table: the features of each block of each page, then its label."""
    rows = []
    for parts in pages:
        page, labels = page_of(parts)
        found = block_features(page_blocks(page))
        assert len(found) == len(labels)
        rows += [(*x, y) for x, y in zip(found, labels)]
    return tuple(rows)


@lru_cache(maxsize=4)
def default_tree(pages: tuple = LABELLED_PAGES):
    return grow(measured(pages))


def decide(tree, features) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def boiler_kind(tag: str, attrs: str, inside: bool) -> int:
    """2 for a menu, footer, comments and the like, 1 for what an article may lie in still, else 0."""
    if tag in BOILER:
        return 2
    kind = int(tag in WRAPPER and not (tag == "header" and inside))
    if not attrs or tag in ("html", "body", "main"):
        return kind
    for match in NAMES.findall(attrs):
        for name in "".join(match).split():
            if STRONG.fullmatch(name):
                return 2
            if WEAK.fullmatch(name) or (not inside and TOP.fullmatch(name)):
                kind = 1
    return kind


def page_blocks(page: str) -> list[tuple[str, float, int, int, int]]:
    """(text, link density, number of its article or 0, boiler, heading) of each non-empty block in page order."""
    out: list[tuple[str, float, int, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # tag, article, boiler
    parts: list[str] = []
    linked = plain = links = articles = 0
    heading = False
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked, plain
        text = "".join(parts)
        if text and not text.isspace():
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            article, boiler = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            if text:
                out.append((text, linked / max(1, linked + plain), article, int(boiler > 0), int(heading)))
        parts.clear()
        linked = plain = 0

    def take(text: str) -> None:
        nonlocal linked, plain
        if text:
            parts.append(text)
            if links:
                linked += len(text)
            else:
                plain += len(text)

    def end_of(tag: str, at: int) -> int:
        """Where the element that begins at ``at`` ends; ``at`` if it is never closed."""
        if tag in unclosed:
            return at
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
        if m is None:
            unclosed.add(tag)
        return m.end() if m else len(page) if tag in RAW else at

    at = 0
    while (lt := page.find("<", at)) >= 0:
        m = TAG.match(page, lt)
        if m is None:
            mark = page[lt + 1 : lt + 2]
            if mark in ("!", "?", "/"):  # comments, declarations and end tags without a name
                take(page[at:lt])
                end = page.find("-->", lt + 2) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
                at = end if end > lt else len(page)
            else:
                take(page[at : lt + 1])
                at = lt + 1
            continue
        take(page[at:lt])
        at, tag = m.end(), m["tag"].lower()
        closing, alone = m["end"], m["attrs"].endswith("/")
        if tag in RAW or tag in UNSEEN:
            if not closing and not alone:
                at = end_of(tag, at)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            take(" ")
        elif tag in BLOCKS or tag == "head":
            flush()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                heading = False
                if tag != "p":
                    links = 0
            elif tag not in VOID and not alone:
                if tag in LEAVES:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] not in LEAVES:
                            break
                        if stack[i][0] == tag or stack[i][0] == "p":
                            del stack[i:]
                            break
                article, boiler = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
                kind = boiler_kind(tag, m["attrs"], article > 0)
                if tag in ("article", "main") and not article and boiler < 2 and kind < 2:
                    articles += 1
                    article, boiler = articles, kind
                stack.append((tag, article, max(boiler, kind)))
                heading = tag[0] == "h" and tag[1:].isdigit()
    take(page[at:])
    flush()
    return out


def block_features(blocks: list[tuple[str, float, int, int, int]]) -> list[tuple]:
    """The FEATURES of each block."""
    sizes = [(len(b[0].split()), b[1]) for b in blocks]
    words: dict[int, int] = {}
    for (n, _), b in zip(sizes, blocks):
        if b[2]:
            words[b[2]] = words.get(b[2], 0) + (0 if b[3] else n)
    main = min(words, key=lambda a: (-words[a], a)) if words else 0
    out = []
    for i, (_, _, article, boiler, heading) in enumerate(blocks):
        before = sizes[i - 1] if i else (0, 0.0)
        after = sizes[i + 1] if i + 1 < len(blocks) else (0, 0.0)
        out.append((*sizes[i], *before, *after, (1 if article == main else -1) if main else 0, boiler, heading))
    return out


def main_text(page: str | None, tree=None) -> str:
    blocks = page_blocks(page or "")
    tree = default_tree() if tree is None else tree
    return "\n".join(b[0] for b, x in zip(blocks, block_features(blocks)) if decide(tree, x))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple = LABELLED_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every page, by the tree grown from the ``labelled`` pages."""
    tree = default_tree(labelled)

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
