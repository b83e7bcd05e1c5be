"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. Menus, adverts and the like, and their links, become empty lines, as
many as a window is long. Sums of text lengths over sliding windows of lines then rise from zero at a surge and fall
back to zero at a dive; the text lies between them, in the stretches whose densest window comes near the densest of the
page. A marked article bounds a block: it is one stretch, whatever is set apart in it, and its windows count for more.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import mapped, small_batches

WINDOW = 3  # lines
NEAR_DENSEST = 0.25  # a stretch's densest window against the page's
MARKED_WEIGHT = 4  # of a stretch's densest window in a marked article
MOST_LINKED = 0.5  # share of a stretch's text that may be links, outside marked articles

# Elements by what HTML says of them.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section select summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = set("nav aside footer form menu dialog select button search fieldset".split())
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Words in a class, an identifier or a role that tell what is not the article, a judgement; and words that say nothing
# beside them. A name with any other word, such as "related-work" or "notice-period", tells nothing.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login menu menubar nav navbar"
    " navigation breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer header masthead share sharing social"
    " related recommended comment comments respond reply replies disqus complementary contentinfo form search toolbar"
    " widget widgets skip".split()
)

NEUTRAL_WORDS = set(
    "area article bar block body bottom box button buttons container content email frame global group inner item items latest left link"
    " links list main more my outer page panel post posts reader readers right section site slot small top unit user users wrap wrapper zone".split()
)
# A tag ends at the first ">" that is not in a quoted value. Quotes mean something right behind a "=" only, and one that is
# never closed means nothing, so that a stray quote loses no text. Nothing is tried twice: time is linear.
TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|$)|<!--.*?(?:-->|$)|<[!?/][^>]*+(?:>|$)""", re.S
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Line:
    text: str
    linked: int  # characters of it in links
    inside: bool  # in a marked article


def set_apart(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is none of the article, by its name or by what its attributes say."""
    if name in ASIDE or (name == "header" and not inside):
        return True
    if name in MAIN or name in ("html", "body") or not attributes.strip():
        return False
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key not in ("class", "id", "role") or name in HEADINGS:
            continue
        for given in value.split():
            words = {w.lower() for w in WORDS.findall(given)}
            said = words & ASIDE_WORDS
            if inside:
                said.discard("header")  # an article's own
            if said and not words - ASIDE_WORDS - NEUTRAL_WORDS:
                return True
    return False


def closes(page: str, at: int, name: str, depth: int) -> bool:
    """Whether an element that is ``depth`` deep at a place is closed further on."""
    for found in TAG.finditer(page, at):
        if (found[2] or "").lower() == name and found[4]:
            depth += -1 if found[1] else 0 if found[3].endswith("/") else 1
            if depth == 0:
                return True
    return False


def lines_of(page: str, trusting: bool = True) -> list[Line]:
    """The blocks of a page in order; what is set apart leaves ``WINDOW`` empty lines, except in a marked article. What
    is set apart ends at an article if it is never closed, or at any article if its end is not ``trusting``."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = links = main = 0
    skipping, depth, closed = "", 0, None
    at = 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append(Line(text, min(linked, len(text)), main > 0))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not skipping:
            text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())

    while True:
        found = TAG.search(page, at)
        add(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        closing, name = found[1], (found[2] or "").lower()
        if not name or not found[4]:  # a comment, a declaration, or a tag that the page ends in
            continue
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\s*(>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skipping:
            if name == skipping:
                depth += -1 if closing else 0 if found[3].endswith("/") else 1
                if depth == 0:
                    skipping = ""
            elif name == "body" and closing:
                skipping = ""  # never closed
            elif name in MAIN and not closing:
                closed = trusting and closes(page, at, skipping, depth) if closed is None else closed
                skipping = skipping if closed else ""
            if skipping or closing and name not in MAIN:
                continue
        if name in BLOCKS:
            end_block()
        if name == "a":
            links = 0 if closing else 1
        if name in MAIN:
            main = max(0, main + (-1 if closing else 1))
            if main == (0 if closing else 1):  # the outermost
                lines.extend([Line("", 0, False)] * WINDOW)
        elif not closing and name not in VOID and set_apart(name, found[3], main > 0):
            if name in BLOCKS and not main:
                lines.extend([Line("", 0, False)] * WINDOW)
            skipping, depth, closed = name, 1, None
    end_block()
    return lines


def stretches(lengths: np.ndarray) -> list[tuple[int, int]]:
    """From each surge, where the sums over windows of lines leave zero, to the dive, where they are zero again."""
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[: len(lengths)]  # of the window that ends at a line
    above = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def main_text(page: str | None) -> str:
    """The text of a page's article, its blocks joined by line feeds; empty if there is none."""
    lines = lines_of(page or "")
    if page and not any(line.text for line in lines):  # all within something set apart
        lines = lines_of(page, trusting=False)
    lengths = np.array([len(x.text) for x in lines], np.int64)
    if not lengths.any():
        return ""
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[: len(lengths)]
    kept = []
    for a, b in stretches(lengths):
        inside = any(line.inside for line in lines[a:b])
        dense = sums[a:b].max() * (MARKED_WEIGHT if inside else 1) >= NEAR_DENSEST * sums.max()
        linked = sum(x.linked for x in lines[a:b]) > MOST_LINKED * lengths[a:b].sum()
        if dense and (inside or not linked):
            kept.extend(line.text for line in lines[a:b] if line.text)
    return "\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The identifier, the address, ``text`` and ``n_chars``, its code points, of every page.

    A missing or empty page, and one without an article, has an empty text. Pages are independent: repeated rows give
    repeated results, an empty table an empty one; other columns are ignored. Nothing is shuffled, and a task holds one
    batch of pages of 4 MB, or one longer page.
    """
    chosen = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kinds = [chosen.schema[c].dataType.simpleString() for c in ("id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    found = mapped(chosen, run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return found.withColumnsRenamed({"id": page_id, "url": url})
