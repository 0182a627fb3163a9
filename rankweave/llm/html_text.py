"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities of neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.sources.tables import spread, table

#: Fixed values of HTML: elements whose content is no markup, elements without content, and elements that stand within a line.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that a sibling of the same name ends.
SIBLINGS = frozenset("p li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no main text, elements that hold it, and the words that say so in class, id and role.
APART = frozenset("head nav footer aside form dialog menu button select svg math template object canvas audio video".split())
MAIN = frozenset("article main".split())
APART_WORD = re.compile(
    r"nav(igation|bar)?|menu(bar)?|masthead|topbar|foot|aside|side|widget|ads?|adv|adsense|adslot|notice|banner|consent|gdpr|alert|popup|modal|overlay|signup|login|search|shar(e|ing)|social|"
    r"related|popular|trending|respond|repl(y|ies)|disqus|discussion|feedback|reviews?|form|copyright|legal|pag(ination|er)|skip|toolbar|teaser|contentinfo|complementary|dialog|"
    r"(breadcrumb|sidebar|navig|footer|recommend|advert|sponsor|promo|cookie|comment|subscri|newsletter).*"
)
MAIN_WORD = re.compile(r"article|main|post|entry|story|content|body|text|prose")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|iframe|noembed|noframes|xmp)(?=[\s/>])(?:[^"'>]|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:(?:[^"'>]|"[^"]*"|'[^']*')*+|[^>]*))>|<[!?/][^>]*>""",
    re.I | re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HREF = re.compile(r"""(?:^|[\s"'])href\s*=""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    """A flat text block: where it begins in the page, its text, and what the tree looks at besides its neighbours."""

    at: int
    text: str
    words: int
    linked: int  # words within links
    heading: int
    inside: int  # within an element that holds no main text, itself within the element of the main text, if any
    main: int  # within an element that holds main text
    outside: int  # within an element that holds no main text, around that of the main text
    mark: int  # begins as a copyright line does


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "heading", "inside", "main", "outside", "mark")


def _kind(name: str, attributes: str) -> str:
    """``apart``, ``head`` (apart outside of main text alone), ``main`` or nothing, from an element's name and attributes."""
    if _HIDDEN.search(attributes):
        return "apart"
    parts = [p.lower() for value in _NAMED.findall(attributes) for p in _PART.findall(value)] if "=" in attributes else []
    if name in APART or any(APART_WORD.fullmatch(p) for p in parts):
        return "apart"
    if name in MAIN or (name not in ("body", "html") and any(MAIN_WORD.fullmatch(p) for p in parts)):
        return "main"
    return "head" if name == "header" or "header" in parts else ""


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; markup that is broken or unfinished ends where the page does."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # open elements and their kinds
    names: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    begins, link = 0, -1  # link: how many elements were open where the open link began

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if text:
                linked = len(html.unescape(" ".join(t for t, inside in pieces if inside)).split())
                words = text.count(" ") + 1
                kinds = [k for _, k in stack if k]
                inner = next((n for n in range(len(kinds) - 1, -1, -1) if kinds[n] == "main"), -1)
                outer = next((n for n, k in enumerate(kinds) if k == "main"), len(kinds) if inner < 0 else 0)
                inside = "apart" in kinds[inner + 1 :] or (inner < 0 and "head" in kinds)
                outside = inner >= 0 and ("apart" in kinds[: inner + 1] or "head" in kinds[:outer])
                heading = any(n in HEADINGS for n, _ in stack[-2:])
                found.append(Block(begins, text, words, min(linked, words), int(heading), int(inside), int(inner >= 0), int(outside), int(text.startswith(("©", "(c)", "Copyright")))))
            pieces.clear()

    def close(until: int) -> None:
        nonlocal link
        for name, _ in stack[until:]:
            names[name] -= 1
        del stack[until:]
        if link > len(stack):
            link = -1

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            if not pieces:
                begins = at
            pieces.append((page[at : token.start()], link >= 0))
        at = token.end()
        if not (name := token["name"]):
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                link = len(stack) if not token["end"] and _HREF.search(token["rest"]) else -1
            elif name == "br":
                pieces.append((" ", link >= 0))
            continue
        flush()
        if token["end"]:
            if names[name]:
                close(max(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name) if stack[-1][0] != name else len(stack) - 1)
        elif name not in VOID:
            if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in SIBLINGS)):
                close(len(stack) - 1)
            if not token["rest"].endswith("/") or name not in ("svg", "math"):
                stack.append((name, _kind(name, token["rest"])))
                names[name] += 1
    if at < len(page):
        if not pieces:
            begins = at
        pieces.append((page[at:], link >= 0))
    flush()
    return found


def features(page_blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the ends of the page stand blocks without words."""
    own = np.array([(b.words, b.linked / b.words) for b in page_blocks], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1]])[: len(own)], np.vstack([own[1:], edge])[: len(own)]
    return np.hstack([own, before, after, np.array([b[4:] for b in page_blocks], dtype=float).reshape(-1, 5)])


def grown(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A decision tree by Gini impurity: a bool, or (feature, limit, tree where at most the limit, tree beyond)."""
    share = y.mean() if len(y) else 1.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, kept = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = kept[:-1] / n, (kept[-1] - kept[:-1]) / (len(y) - n)
        cost = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
        cost[(values[1:] == values[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(cost.argmin()) if len(cost) else 0
        if len(cost) and np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-9):
            best = (cost[k], f, (values[k] + values[k + 1]) / 2)
    if best is None:
        return bool(share >= 0.5)
    _, f, limit = best
    low = x[:, f] <= limit
    below, above = grown(x[low], y[low], depth - 1, least), grown(x[~low], y[~low], depth - 1, least)
    return below if isinstance(below, bool) and below is above else (f, float(limit), below, above)


def judged(tree, x: np.ndarray) -> np.ndarray:
    """What the tree says of every row."""
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, limit, low, high = tree
    return np.where(x[:, f] <= limit, judged(low, x), judged(high, x))


#: The labelled table: pages as parts of markup, ``+`` where a part's text belongs to the main text; {n} stands for n words.
LABELLED = (
    ("-<body><nav><ul><li><a href=x>{1}</a><li><a href=x>{2}</a><li><a href=x>{1}</a></ul></nav><div class=ad>{9}</div>", "+<article><h1>{8}</h1><p>{48}</p><p>{12}</p><p>{70}</p>", "-</article><footer>© {7} {4}</footer>"),
    ("-<header><h1><a href=x>{3}</a></h1><p>{6}</p></header><div class=cookie-notice><p>{20}</p></div>", "+<main><h2>{5}</h2><p>{3}</p><p>{33}</p><p>{1}</p>", "-</main><aside><h3>{2}</h3><p>{25}</p></aside><footer><p>{14}</p></footer>"),
    ("-<div id=menu><a href=x>{1}</a> <a href=x>{2}</a></div>", "+<div class=post-content><h1>{7}</h1><p>{55}</p><ul><li>{4}</li><li>{9}</li></ul><blockquote>{18}</blockquote></div>", "-<div id=comments><h3>{2}</h3><p>{30}</p><p>{45}</p><p>{5}</p></div><form><label>{3}</label><p>{10}</p></form>"),
    ("-<body><div><a href=x>{2}</a> | <a href=x>{1}</a> | <a href=x>{3}</a></div>", "+<h1>{6}</h1><p>{40}</p><p>{4}</p><p>{62}</p><p>{9}</p><p>{28}</p>", "-<p>© {5}</p>"),
    ("-<table><tr><td><a href=x>{1}</a></td><td><a href=x>{2}</a></td></tr></table>", "+<p>{85}</p><p>{44}</p><p>{2}</p><p>{51}</p>", "-<div><a href=x>{4}</a> {1} <a href=x>{5}</a></div><div>Copyright {6}</div>"),
    ("-<header class=site-header>{4}</header>", "+<article><header><h1>{9}</h1></header><p>{5} <a href=x>{2}</a> {22}</p><h2>{3}</h2><p>{60}</p><pre>{15}</pre>", "-<div class=share-buttons>{3}</div><section class=comments><h2>{2}</h2><article class=comment><p>{40}</p><p>{8}</p></article></section></article>"),
    ("-<aside class=sidebar><h2>{2}</h2><p>{60}</p><ul><li><a href=x>{5}</a></li><li><a href=x>{6}</a></li></ul></aside>", "+<main><article><p>{4}</p><p>{90}</p><p>{6}</p>", "-</article><section id=comments><p>{33}</p><p>{12}</p></section></main>"),
    ("-<ul><li><a href=x>{1}</a></li><li><a href=x>{1}</a></li><li><a href=x>{2}</a></li></ul>", "+<div><h2>{6}</h2><p>{37}</p><p>{58}</p><table><tr><td>{3}</td><td>{2}</td></tr></table><p>{41}</p></div>", "-<ul><li><a href=x>{5}</a></li><li><a href=x>{7}</a></li><li><a href=x>{4}</a></li></ul><p>(c) {8}</p>"),
    ("-<div role=banner>{5}</div><div class=advert>{40}</div><div role=navigation><a href=x>{2}</a></div>", "+<div id=article-body><p>{11}</p><p>{75}</p><p>{2}</p></div>", "-<div class=newsletter-signup>{22}</div><div role=contentinfo>{11}</div>"),
    ("-<div class=banner>{16}</div>", "+<article><h1>{4}</h1><p>{7}</p><p>{1}</p>", "-<aside class=ad>{12}</aside>", "+<p>{31}</p>", "-<nav><a href=x>{3}</a></nav><footer>{9}</footer><div class=related><a href=x>{8}</a><p>{19}</p></div></article>"),
    ("-<p><a href=x>{3}</a></p>", "+<p>{66}</p><p>{5} <a href=x>{1}</a> {30}</p><h3>{4}</h3><p>{49}</p>", "-<p><a href=x>{2}</a> <a href=x>{3}</a></p>"),
    ("-<nav><a href=x>{2}</a></nav>", "+<article><h1>{6}</h1><p>{30}</p><p>{8}</p><p>{2}</p></article>"),
    ("+<p>{64}</p><p>{5}</p><p>{38}</p>",),
    ("+<h1>{5}</h1><p>{26}</p><p>{71}</p><p>{20}</p>",),
    ("-<div>{2}</div><div>{3}</div><div>{1}</div>", "+<h1>{8}</h1><p>{47}</p><p>{6}</p><p>{59}</p><p>{21}</p>", "-<div>{3}</div><div>{2}</div><div>{4}</div><div>{2}</div>"),
    ("-<div>{1}</div><div><a href=x>{3}</a></div><div>{4}</div>", "+<div>{36}</div><div>{53}</div><div>{3}</div><div>{45}</div>", "-<div>{5}</div><div><a href=x>{2}</a></div><div>{3}</div>"),
    ("-<div><a href=x>{2}</a></div><div>{2}</div>", "+<h2>{4}</h2><div>{58}</div><h2>{3}</h2><div>{67}</div><h2>{7}</h2><div>{39}</div>", "-<div>{2}</div><div>{3}</div>"),
    ("-<div class=top-menu>{4}</div>", "+<h1>{7}</h1><div class=content><p>{9}</p><p>{2}</p><p>{44}</p><p>{1}</p></div>", "-<div class=social>{2}</div><div>{3}</div><div>{2}</div>"),
    ("-<form class=search><p>{2}</p></form>", "+<article><h1>{3}</h1><p>{4}</p><p>{5}</p><p>{2}</p><p>{3}</p></article>", "-<p>{2}</p><p>{3}</p><div>{6}</div>"),
    ("-<form>{12}</form>", "+<main><h1>{3}</h1><p>{1}</p><p>{11} <a href=x>{2}</a></p></main>", "-<div>{4}</div><div>{1}</div>"),
    ("-<div class=ads>{11}</div>", "+<main><p>{7}</p><p>{3}</p></main>"),
    ("+<div class=entry><p>{20}</p><p>{12}</p><p>{4}</p></div>",),
    ("-<aside>{30}</aside>", "+<article><h1>{5}</h1><p>{6}</p></article>"),
    ("-<nav><a href=x>{1}</a></nav>", "+<article><p>{1}</p></article>"),
    ("+<p>{5}</p>",),
    ("+{9}",),
    ("+<p>{45}</p><p>{6}</p>",),
    ("+<p>{2}</p>",),
    ("+{4}",),
    ("+<div>{3}</div>",),
    ("-<header>{2}</header>", "+<article><p>{24}</p><p>{1} <a href=x>{2}</a></p><p>{31}</p><p><a href=x>{3}</a></p><p>{50}</p></article>", "-<footer><a href=x>{2}</a></footer>"),
    ("-<header>{2}</header>", "+<main><h2>{4}</h2><p>{17}</p><p>{2} <a href=x>{4}</a> {1}</p><p>{28}</p>", "-<div><a href=x>{4}</a></div><div><a href=x>{6}</a></div><div><a href=x>{3}</a></div></main>"),
    ("-<nav><a href=x>{1}</a></nav>", "+<main><article><h1>{4}</h1><p>{25}</p></article>", "-<section class=comments><article><p>{9}</p><p>{30}</p></article><article><p>{3}</p></article></section></main>"),
    ("-<div class=consent role=dialog><p>{35}</p><button>{1}</button></div>", "+<main><p>{6}</p><p>{24}</p><p>{3}</p><p>{80}</p>", "-<ul class=pagination><li>{1}</li><li><a href=x>{1}</a></li></ul><ul><li><a href=x>{6}</a></li><li><a href=x>{4}</a></li></ul></main><div>{7}</div>"),
)


def labelled_pages(spark: SparkSession) -> DataFrame:
    """The labelled table as (page, part, keep, html), a part's html as it stands in the page."""
    filled = lambda t: re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), t)
    rows = [(p, k, part[0] == "+", filled(part[1:])) for p, parts in enumerate(LABELLED) for k, part in enumerate(parts)]
    return spark.createDataFrame(rows, "page int, part int, keep boolean, html string")


def fit(labelled: DataFrame, most_parts: int = 10_000):
    """A tree from ``labelled`` (page, part, keep, html): the parts of a page make its html, each all main text or none of it.

    The table is small by contract: more than ``most_parts`` rows raise. Null html is empty, a null keep is none; rows without
    page or part teach nothing; an empty table gives a tree that keeps everything.
    """
    rows = labelled.where("page is not null and part is not null").selectExpr("page", "part", "coalesce(keep, false) keep", "coalesce(html, '') html").limit(most_parts + 1).collect()
    if len(rows) > most_parts:
        raise ValueError(f"more than {most_parts} labelled parts")
    pages: dict[object, list] = {}
    for row in sorted(rows, key=lambda r: (r["page"], r["part"], r["html"], r["keep"])):
        pages.setdefault(row["page"], []).append(row)
    x, y = [np.empty((0, len(FEATURES)))], []
    for parts in pages.values():
        found = blocks("".join(r["html"] for r in parts))
        ends = np.cumsum([len(r["html"]) for r in parts])
        x.append(features(found))
        y += [parts[int(np.searchsorted(ends, b.at, "right"))]["keep"] for b in found]
    return grown(np.vstack(x), np.array(y, dtype=float))


def main_text(page: str | None, tree) -> str:
    """The kept blocks of a page, one a line."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, judged(tree, features(found))) if keep) if found else ""


def with_main_text(pages: DataFrame, tree, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each row's html as a further column (in place of one of that name), row by row, nothing shuffled.

    Null and empty html give an empty text, so do pages without any kept block; a page is read whole whatever its length.
    Repeated rows stay, each with its text; other columns, whatever their names, are not sent to Python. An empty table stays empty.
    """

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py(), tree) for page in batch], pa.string())

    return pages.withColumn(name, extracted(F.col(f"`{html_column}`").cast("string")))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = with_main_text(pages, fit(labelled_pages(spark)))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
