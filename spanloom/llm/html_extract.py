"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags.  A word's score is the log-odds of
being content, learned by logistic regression from labelled pages: a weight for
each element name and each word of its class, id or role attribute, summed over
the elements that are open.  Positive words score up to 1, words that look like
boilerplate slightly below 0, tags negative.  A linear scan finds the contiguous
region with the greatest sum; its blocks with a positive mean are the text, and so
are such blocks outside it that stand in the same content container, however much
boilerplate lies between: the container of a block is the outermost element around it
that is itself learned as content, else the innermost of ``_HOLDERS`` around it.  The
labelled pages are made by :func:`labelled_pages`: layouts with
articles, menus, notices, adverts, forms and comments in varying mark-up.

Block text: character references decoded, white space as single blanks, trimmed;
blocks in page order, joined by two newlines.

Scripts, styles, templates, titles, frames, drawings, text areas and choices are left out
with all they hold; what noscript, object, canvas and math hold is read as any mark-up.

Edge cases: null and empty html give an empty text; unclosed elements and cut
pages are read as far as they go; without any positive word the text is empty.  Of
regions with equal sums the first is taken.  Repeated rows are read each; an empty table
gives an empty one; other columns are not read, whatever their names.  A page whose
article is itself named as a comment or a notice is taken for one.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

TAG_COST, LOW = -0.1, -0.05

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>"
    r"|<(script|style|template|textarea|title|iframe|svg|select)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover q s samp semantics small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = frozenset("li dt dd tr td th option p".split())
_HOLDERS = frozenset("html body main article section div".split())


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is known by: its name and the words of class, id and role."""
    words = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        words += ["." + w for w in _WORD.findall(m[1].lower())]
    return tuple(dict.fromkeys(words))


@dataclass(slots=True)
class _Open:
    """An open element with what its ancestors add up to: the log-odds of its words and its content container."""

    tag: str
    names: tuple[str, ...]
    score: float
    outer: int  # the outermost element around that is learned as content and may be a container
    inner: int  # the innermost one that may be a container


def scan(page: str, weights: dict[str, float]) -> Iterator[tuple[str | None, list[_Open], bool | None]]:
    """The page as (text, open elements, False) and (None, open elements, whether it breaks a block; None: a line only).

    The list of open elements is one and the same and changes.  Each tag is looked at a bounded
    number of times and an end tag that nothing has opened not at all, so the time is linear in the page.
    """
    stack = [_Open("", (), weights.get("", 0.0), 0, 0)]
    opened: Counter[str] = Counter()
    number = at = 0

    def close(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def close_last(tag: str) -> None:
        """Ends the innermost ``tag`` with no block in it."""
        k = len(stack) - 1
        while opened[tag] and k and stack[k].tag != tag and stack[k].tag in _INLINE:
            k -= 1
        if k and stack[k].tag == tag:
            close(k)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield page[at : m.start()], stack, False
        at = m.end()
        if not m[3]:
            if m[1]:
                yield None, stack, True
            continue
        tag = m[3].lower()
        if m[2]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
        elif tag not in _VOID:
            if tag in _CLOSES_P:
                close_last("p")
            if tag in _SAME:
                close_last(tag)
            if tag != "math" or not m[4].endswith("/"):
                number += 1
                names, around = _names(tag, m[4]) if m[4] else (tag,), stack[-1]
                own = sum(weights.get(name, 0.0) for name in names)
                outer = around.outer or (number if tag in _HOLDERS and tag not in ("html", "body") and own > 0 else 0)
                stack.append(_Open(tag, names, around.score + own, outer, number if tag in _HOLDERS else around.inner))
                opened[tag] += 1
        yield None, stack, None if tag == "br" else tag not in _INLINE
    if at < len(page):
        yield page[at:], stack, False


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    if not page:
        return ""
    blocks: list[tuple[list[str], float, int]] = []  # texts, sum of log-odds, content container (0: none) at the first word
    sequence: list[tuple[float, int]] = []  # score, block
    texts: list[str] = []
    total, words, place = 0.0, 0, 0

    def close() -> None:
        nonlocal texts, total, words
        if words:
            blocks.append((texts, total, place))
        texts, total, words = [], 0.0, 0

    for text, stack, breaks in scan(page, weights):
        if text is None:
            if breaks:
                close()
            elif breaks is None:
                texts.append(" ")
            sequence.append((TAG_COST, -1))
            continue
        s = stack[-1].score
        texts.append(text)
        n = len(html.unescape(text).split())
        if n:
            place = place if words else stack[-1].outer or stack[-1].inner
            total, words = total + s * n, words + n
            sequence.append((n * (min(s, 1.0) if s > 0 else LOW), len(blocks)))
    close()
    best, run, start, span = 0.0, 0.0, 0, (0, 0)
    for k, (s, _) in enumerate(sequence):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, span = run, (start, k + 1)
    inside = {b for _, b in sequence[span[0] : span[1]] if b >= 0 and blocks[b][1] > 0}
    containers = {blocks[b][2] for b in inside}
    chosen = [b for b, (_, score, held) in enumerate(blocks) if b in inside or inside and score > 0 and held in containers]
    out = [" ".join(html.unescape("".join(blocks[b][0])).split()) for b in chosen]
    return "\n\n".join(t for t in out if t)


#: Mark-up of the labelled pages, (element, class or id names).
_CONTENT = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "story"), ("div", "article-text"), ("div", "main-content"), ("section", ""), ("div", "")]
_BOILERPLATE = [
    ("nav", ""), ("nav", "menu"), ("ul", "menu"), ("div", "nav-bar"), ("div", "breadcrumbs"), ("header", ""), ("header", "site-header"), ("div", "header"), ("div", "top-bar"), ("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"),
    ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "recommended"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad"), ("div", "banner"), ("div", "sponsored"), ("div", "promo"), ("ins", "ad"),
    ("div", "cookie"), ("div", "cookie-notice"), ("div", "notice"), ("div", "consent"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("dialog", ""), ("form", ""), ("form", "search"), ("form", "login"), ("fieldset", ""), ("div", "newsletter"), ("div", "subscribe"), ("div", "signup"), ("div", "share"), ("div", "social"), ("div", "toolbar"), ("div", "pagination"), ("div", "tags"),
    ("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment-list"), ("article", "comment"), ("div", "respond"), ("div", "replies"), ("div", "disqus"), ("button", ""), ("menu", ""), ("address", ""),
]


def labelled_pages(count: int = 600, seed: int = 3) -> Iterator[tuple[str, list[bool]]]:
    """Pages with, for each of their text runs in order, whether it is content."""
    rng = random.Random(seed)

    def text(n: int) -> str:
        return " ".join("".join(rng.choice("aeiorstnl") for _ in range(rng.randint(2, 8))) for _ in range(n))

    def attribute(name: str) -> str:
        return f' {rng.choice(["class", "class", "id", "role"])}="{name}"' if name else ""

    for _ in range(count):
        parts: list[str] = []
        marks: list[bool] = []

        def put(element: str, name: str, content: bool, inner: str = "", parts=parts, marks=marks) -> None:
            parts.append(f"<{element}{attribute(name)}>")
            for _ in range(rng.randint(1, 3)):
                tag = inner or rng.choice(["p", "div", "span", "li", "a", "h3", "p", ""])
                parts.append(f"<{tag}>" if tag else "")
                parts.append(text(rng.randint(1, 12)))
                marks.append(content)
                parts.append(f"</{tag}>" if tag else "<br>")
            parts.append(f"</{element}>")

        for _ in range(rng.randint(1, 4)):
            put(*rng.choice(_BOILERPLATE), False)
        element, name = rng.choice(_CONTENT)
        parts.append(f"<{element}{attribute(name)}>")
        if rng.random() < 0.7:
            parts.append(f"<h1>{text(6)}</h1>")
            marks.append(True)
        for _ in range(rng.randint(1, 6)):
            chance = rng.random()
            if chance < 0.25:
                put(*rng.choice(_BOILERPLATE), False)
            elif chance < 0.35:
                put(rng.choice(["blockquote", "ul", "figure", "table", "pre", "div", "section"]), "", True)
            else:
                tag = rng.choice(["p", "p", "p", "h2", "p"])
                parts.append(f"<{tag}>{text(rng.randint(5, 40))}</{tag}>")
                marks.append(True)
        parts.append(f"</{element}>")
        for _ in range(rng.randint(1, 4)):
            put(*rng.choice(_BOILERPLATE), False)
        yield "<html><body>" + "".join(parts) + "</body></html>", marks


@cache
def learned_weights(count: int = 1200, steps: int = 300, decay: float = 2e-4) -> dict[str, float]:
    """Logistic regression on the labelled pages; "" is the bias."""
    index: dict[str, int] = {"": 0}
    rows, labels = [], []
    for page, marks in labelled_pages(count):
        runs = [[name for e in stack for name in e.names] for text, stack, _ in scan(page, {}) if text is not None]
        for names, mark in zip(runs, marks, strict=True):
            rows.append([0] + [index.setdefault(name, len(index)) for name in names])
            labels.append(mark)
    width = np.array([len(r) for r in rows])
    at, flat = np.repeat(np.arange(len(rows)), width), np.concatenate(rows)
    y, w = np.array(labels, float), np.zeros(len(index))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=w[flat], minlength=len(rows)), -60, 60)))
        g = np.bincount(flat, weights=(p - y)[at], minlength=len(w)) / len(rows) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return {name: float(w[k]) for name, k in index.items()}


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text) for each row of ``pages``."""
    weights = learned_weights() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [extract(t.as_py(), weights) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(scratch.lean(run), "page_id long, url string, text string")
