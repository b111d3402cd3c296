"""Main text of web pages by line-block distribution.

A page becomes lines, one for each block of text. A line weighs the characters of its
text that aren't link text; lines of menus, headers, footers, sidebars, notices, adverts,
forms and comments weigh nothing, lines of an article element weigh IN_ARTICLE more. The
weights of WINDOW lines from each line on are summed: text begins where that sum surges
to at least SURGE, and ends where it dives to zero; what lies between is kept. A window's
IN_ARTICLE alone is below SURGE, so lengths decide on every page, inside and outside of
article elements. Where article lines hold most of a page's text, lines outside are summed
apart from them: scraps beside an article are no part of it, but longer text is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, text_or_empty

WINDOW = 3
SURGE = 80
IN_ARTICLE = 25

#: Element names and words in class, id or role by what they mean here.
RAW = set("script style textarea title iframe".split())  # their content is no markup; without an end tag it is the rest of the page
DROPPED = set("noscript template svg object select datalist canvas audio video".split())  # with their content, up to the end tag; a start tag without one drops nothing
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CONTAINERS = set("article aside blockquote body center dd details dialog div dl dt fieldset figure footer form head header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
APART = set("aside button dialog fieldset footer form head menu nav".split())
APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc sidebar aside footer header masthead topbar comment comments commentlist respond reply replies discussion disqus related recommended recommendations "
    "share sharing social widget pagination pager login search searchform toolbar skip copyright legal complementary contentinfo".split())
OFTEN_IN_ARTICLES = {"header", "widget", "legal"}
#: Words that name content too; inside an article a long line with little link text overrules them.
WEAK_WORDS = {"related", "recommended", "recommendations", "share", "sharing", "social", "skip", "menu"}
ARTICLES = {"article", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|$)|<[a-z][^>]*(?:>|$)", re.I | re.S)
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|$)", re.I) for x in RAW}
_ANY_DROPPED = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


NOT_APART, WEAKLY_APART, IS_APART = range(3)


def _apart(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element's text is no part of an article, by its name and attributes; weakly if only WEAK_WORDS in an article say so."""
    if name in APART or (name == "header" and not in_article):
        return IS_APART
    if not attrs.strip() or name in ("html", "body"):
        return NOT_APART
    apart_words = APART_WORDS - OFTEN_IN_ARTICLES if in_article else APART_WORDS
    words = {w for m in _NAMED.finditer(attrs) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower())}
    found = words & apart_words
    if _HIDDEN.search(attrs) or found - WEAK_WORDS or (found and not in_article):
        return IS_APART
    return WEAKLY_APART if found else NOT_APART


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name ("" if not an element), whether it closes, and attributes, of each tag and comment; raw content belongs to its start tag."""
    at, in_svg = 0, False
    while m := _TOKEN.search(page, at):
        at = m.end()
        name, close, attrs = (m["name"] or "").lower(), bool(m["close"]), m["attrs"] or ""
        empty = attrs.rstrip().endswith("/")
        if name == "svg":
            in_svg = not close and not empty
        elif name in BLOCKS:
            in_svg = False
        if name in RAW and not close:
            if not (in_svg and empty):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            name = ""
        yield m.start(), at, name, close, attrs


def _dropped(page: str) -> Iterator[tuple[int, int]]:
    """Outermost spans of DROPPED elements that have an end tag, in order; each end tag belongs to the last open start tag of its name."""
    if not _ANY_DROPPED.search(page):
        return
    opened, spans = {x: [] for x in DROPPED}, []
    for start, end, name, close, attrs in _tokens(page):
        if name not in DROPPED:
            continue
        if not close:
            if not (name == "svg" and attrs.rstrip().endswith("/")):
                opened[name].append(start)
        elif opened[name]:
            spans.append((opened[name].pop(), end))
    until = 0
    for start, end in sorted(spans):
        if start >= until:
            yield start, end
            until = end


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """Text, weight, whether it is in an article element, and whether it is apart, of each line; apart lines weigh 0, those inside an article are left out."""
    out, text, link_chars, links = [], [], 0, 0
    stack: list[tuple[str, int, bool]] = []  # name, apart, in an article
    opened_as: Counter[str] = Counter()
    article, apart, aside, at = False, NOT_APART, NOT_APART, 0  # aside: the block itself says that it is apart

    def end_block() -> None:
        nonlocal link_chars, aside
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        own, level = max(0, len(line) - link_chars), max(apart, aside)
        if article and level == WEAKLY_APART and own >= SURGE:
            level = NOT_APART
        if line and not (article and level):
            out.append((line, 0 if level else own + (IN_ARTICLE if article else 0), article and not level, bool(level)))
        link_chars, aside = 0, NOT_APART

    dropped = _dropped(page)
    span = next(dropped, None)
    for start, end, name, close, attrs in _tokens(page):
        if end <= at:  # in a dropped element
            continue
        if piece := page[at:start]:
            text.append(piece)
            link_chars += len(" ".join(piece.split())) if links else 0
        at = end
        if span and start == span[0]:
            at, span = span[1], next(dropped, None)
            continue
        if not name:
            continue
        if name == "a":
            links = 0 if close else 1
        elif name in ("br", "td", "th"):
            text.append(" ")
        if name in BLOCKS:
            end_block()
            aside = _apart(name, attrs, article) if name not in CONTAINERS and not close else NOT_APART
        if name in CONTAINERS:
            if not close:
                if not attrs.rstrip().endswith("/"):
                    own = _apart(name, attrs, article)
                    stack.append((name, apart, article))
                    opened_as[name] += 1
                    apart = own if name in ARTICLES and not article else max(apart, own)
                    article = (article or name in ARTICLES) and not (own and name in ARTICLES)
            elif opened_as[name]:
                while True:
                    opened, apart, article = stack.pop()
                    opened_as[opened] -= 1
                    if opened == name:
                        break
    text.append(page[at:])
    end_block()
    return out


def main_text(page: str) -> str:
    """Kept lines, joined by line breaks."""
    lines = lines_of(page)
    chars = [(len(line), inside) for line, weight, inside, _ in lines if weight]
    if 2 * sum(n for n, inside in chars if inside) > sum(n for n, _ in chars):
        runs = [list(x) for _, x in groupby(lines, key=lambda x: x[2])]
    else:
        runs = [lines]
    sums = [[sum(x[1] for x in run[k:k + WINDOW]) for k in range(len(run))] for run in runs]
    top = min(SURGE, max((x for run in sums for x in run), default=0)) or SURGE
    kept = []
    for run, ahead in zip(runs, sums):
        inside = False
        for (line, weight, _, apart), total in zip(run, ahead):
            if not inside:
                inside = weight > 0 and total >= top
            elif total == 0:
                inside = False
            if inside and not apart:  # a line that is all link, between others, is text as well
                kept.append(line)
    return "\n".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` and ``n_chars`` (its code points).

    A null or empty html, and a page without text of an article, give the empty text.
    Repeated rows get equal rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(F.col(f"`{html_col}`")).alias("html"))
    out = rows.mapInArrow(_extracted, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
