"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, with weights from labelled
pages: those with exactly one ``article`` or ``main`` element, whose words are content. A word is weighed by
the block it stands in and whether it is a link, a tag by its name; words in menus, adverts, forms and the
like never score positive. One linear scan finds the best contiguous region, whose text is returned without
the parts of it that belong to such elements.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import map_arrow, texts_of

MAX_LABELLED = 5_000

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.DOTALL,
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
# Elements whose content is not text of the page.
RAW = frozenset("script style noscript template iframe textarea select title svg object button head".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE = frozenset("nav aside footer form menu dialog".split())
WHOLE = frozenset("html body article main".split())
TALK = frozenset("comment comments disqus reply replies discussion respond".split())
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar header masthead footer cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login share sharing "
    "social related recommended widget form search pagination pager toolbar contentinfo complementary".split()
)
BODY = frozenset("content article main post entry story text".split())


class Run(NamedTuple):
    """A piece of a page: a tag (``text`` is None) or text between two tags."""

    text: str | None
    feature: str
    off: bool  # inside an element that is no content
    inside: bool  # inside article or main
    gap: bool  # a tag that separates words


def chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds a menu, header, footer, sidebar, notice, advert, form or reader comments."""
    if tag in WHOLE:
        return False
    if tag in SIDE or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    words: set[str] = set()
    for name, *values in NAMED.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            words.update(re.split(r"[^a-z0-9]+", value))
    return bool(words & TALK) or bool(words & CHROME) and not words & BODY


def markup_end(page: str) -> int:
    """Where the last tag may end; a comment that is never closed reaches to the end of the page."""
    last = page.rfind(">") + 1
    return len(page) if page.find("<!--", last) >= 0 else last


def runs(page: str) -> Iterator[Run]:
    """The pieces of a page in order. Unclosed and unopened tags are taken as they come."""
    at = 0
    stack: list[tuple[str, bool]] = []
    off = inside = 0
    block, link = "", 0
    unclosed: set[str] = set()
    # No tag begins after the last end of one, so that broken markup is not searched again from each of its tags.
    for m in MARKUP.finditer(page, 0, markup_end(page)):
        if m.start() < at:
            continue
        if m.start() > at:
            yield Run(page[at : m.start()], f"{block}{'+a' if link else ''}", off > 0, inside > 0, False)
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not close:
            if not attributes.rstrip().endswith("/"):
                stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
                if not stop:
                    unclosed.add(tag)
                # A head or a form control that is never closed hides nothing else.
                at = stop.end() if stop else at if tag in ("head", "button", "select", "object") else len(page)
            yield Run(None, tag, off > 0, inside > 0, tag not in INLINE)
            continue
        if tag == "a":
            link = 0 if close else 1
        elif tag not in INLINE and tag not in VOID:
            block = "" if close else tag
            if not close:
                if tag == "p" and stack and stack[-1][0] == "p":
                    off -= stack.pop()[1]
                if tag in ("article", "main"):
                    # Main content is no part of a menu that was left open.
                    stack = [(t, False) for t, _ in stack]
                    off, link, inside = 0, 0, inside + 1
                bad = chrome(tag, attributes, inside > 0)
                if tag != "p":
                    stack.append((tag, bad))
                    off += bad
                elif bad:
                    stack.append((tag, True))
                    off += 1
            else:
                found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if found is not None:
                    for t, bad in stack[found:]:
                        off -= bad
                        inside -= t in ("article", "main")
                    del stack[found:]
        yield Run(None, close + tag, off > 0, inside > 0, tag not in INLINE)
    if at < len(page):
        yield Run(page[at:], f"{block}{'+a' if link else ''}", off > 0, inside > 0, False)


class Weights(NamedTuple):
    word: dict[str, float]  # by block and link
    tag: dict[str, float]


def size(text: str) -> int:
    return len((entities.unescape(text) if "&" in text else text).split())


def counted(page: str) -> Counter:
    """Of a labelled page: how often each feature stands inside and outside the content; else nothing."""
    opened = len(re.findall(r"<(?:article|main)\b", page, re.IGNORECASE))
    found: Counter = Counter()
    if opened == 1:
        for run in runs(page):
            if run.off:
                continue
            if run.text is None:
                found["tag", run.feature, run.inside] += 1
            else:
                found["word", run.feature, run.inside] += size(run.text)
    return found


def fit(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> Weights:
    """Weights from at most ``max_labelled`` pages, those with the smallest hash of their id.

    A feature that labelled pages don't show has the weight of its kind alone, so no labelled page is needed.
    """
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).where("page_id is not null").distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("page_id"), "page_id").limit(max_labelled))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).join(chosen, "page_id")

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for text in texts_of(batch.column(1)):
            total.update(counted(text.decode()))
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()),
             pa.array([total[k] for k in keys], pa.int64())],
            ["kind", "feature", "inside", "n"],
        )

    sums = map_arrow(rows, part, "kind string, feature string, inside boolean, n long", "html").groupBy("kind", "feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outer")
    )
    word, tag = {}, {}
    # One row for each tag name of the labelled pages, whose number is bounded.
    for r in sums.collect():
        odds = math.log((r.inner + 2) / (r.outer + 1))
        if r.kind == "word":
            word[r.feature] = min(2.0, max(0.02, odds))
        else:
            tag[r.feature] = max(-6.0, min(-0.05, odds - 0.05))
    return Weights(word, tag)


def main_text(page: str, weights: Weights) -> str:
    """Text of the best region: the contiguous runs with the largest sum, of equal ones the longest, first one."""
    pieces = list(runs(page))
    best, best_at = 0.0, (0, 0)
    total, start = 0.0, 0
    for k, run in enumerate(pieces):
        if run.text is None:
            # What a menu within the content holds must not divide it.
            total += -0.05 if run.off else weights.tag.get(run.feature, -0.5)
        elif not run.off:
            n = size(run.text)
            total += n * weights.word.get(run.feature, 1.0 if not run.feature.endswith("+a") else 0.2)
            if n and total >= best and (total > best or best_at[0] == start):
                best, best_at = total, (start, k + 1)
        if total <= 0:
            total, start = 0.0, k + 1
    first, stop = best_at
    # A region within a content element is widened to all of it: tags that labelled pages lack end no article.
    if first < stop and all(run.inside for run in pieces[first:stop] if run.text is not None and not run.off):
        while stop < len(pieces) and pieces[stop].inside:
            stop += 1
        while first and pieces[first - 1].inside:
            first -= 1
    out = []
    for run in pieces[first:stop]:
        if run.text is None:
            out.append(" " if run.gap else "")
        elif not run.off:
            out.append(run.text)
        else:
            out.append(" ")
    return " ".join(entities.unescape("".join(out)).split())


def extract(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row: the main text and its number of characters.

    A null, empty or wordless page has an empty text. Rows that repeat an id are pages of their own.
    """
    weights = fit(pages, max_labelled)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t.decode(), weights) for t in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, part, "page_id long, url string, text string, n_chars long", "html")
