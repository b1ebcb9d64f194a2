"""The main text of web pages, by two passes of rules over blocks.

A page is cut into blocks at block-level tags.  The first pass decides what it
can: blocks in menus, footers, sidebars, notices, adverts, forms and comments
(by element, role, class or id) and blocks made of links are out, but a class, an id
or a form does not put out an element that wraps the article; blocks that
are long enough, with few links and with stop words (or inside ``article`` or
``main``) are in.  Short blocks in between are ambiguous.  The second pass gives
each of them the label of its nearest decided neighbour in the same part of the
page; at equal distance, or with no decided neighbour, it stays in the article
and goes elsewhere.  If a page has an ``article`` or ``main`` with text, only
that is looked at.  If the first pass finds no block to be in (short paragraphs, or
a language without listed stop words), stop words are left aside: blocks of text
with few links are in if they are ``SHORT`` or longer or stand in the page's
densest run of such blocks, and the second pass follows.

A null page is empty and gives an empty text.  Pages are read whole, in linear
time.  Repeated rows give equal results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, LEAST_STOPS, LEAST_STOPS_INSIDE, MOST_LINKS = 140, 0.2, 0.1, 0.5
SHORT = 80
#: Without stop words: the share of links in a block of text, and of letters in its signs.
FEW_LINKS, LEAST_LETTERS = 0.2, 0.5

STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be by at this from or an not have but which
    der die das und ist von den mit zu ein eine im für auf nicht sich des dem auch als
    le la les de des et un une que est pour dans qui sur pas au par plus
    el los las del y en por con una para se lo como más su al""".split()
)
_RAW = {"script", "style", "title", "textarea", "template", "noscript", "iframe", "object", "svg", "math", "head"}
#: Of these an unclosed one ends at the next block.
_DRAWN = {"svg", "iframe", "object", "math"}
_OUT = {"nav", "footer", "aside", "button", "select", "dialog", "menu"}
_MAIN = {"article", "main"}
_BLOCKS = _OUT | _MAIN | set(
    """form address blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6
    header hr html legend li ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
_HINTS = set(
    """ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices
    pagination popup promo promoted related respond share sharing sidebar signup social sponsor sponsored
    subscribe toolbar widget widgets""".split()
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCKS | {'body'}))})\b", re.I)


#: What says that a name tells what a page has, not what the element is.
_ABOUT = {"has", "no", "not", "with", "without", "is", "hide", "show"}


@dataclass
class Block:
    text: str
    link_share: float
    inside: bool
    out: bool
    suspect: int  # the innermost suspect element around it, -1 for none


@dataclass
class Suspect:
    """An element that is out by its name, unless it wraps the article.

    ``sure`` is a name that is nothing but the word for it; any other is also let in
    if it holds most of the page's text.
    """

    parent: int
    sure: bool
    holds_main: bool = False
    chars: int = 0


def _attributes(attributes: str) -> Iterator[tuple[str, str]]:
    for key, *values in _NAMES.findall(attributes):
        yield key.lower(), "".join(values).lower()


def _is_out(name: str, attributes: str, inside: bool) -> bool:
    """Out whatever it holds: by element, role, or because it does not show."""
    if name in _OUT or (name == "header" and not inside):
        return True
    if name in ("html", "body"):
        return False
    return any(
        key == "hidden"
        or (key == "role" and value in _ROLES)
        or (key == "style" and "display:none" in value.replace(" ", ""))
        for key, value in _attributes(attributes)
    )


def _hinted(name: str, attributes: str) -> bool | None:
    """Whether a class or id hints at a part that is out: surely, perhaps, or not.

    An ``article`` is only out by a name that is the word for it, or ends in it.
    """
    if name in ("html", "body", "main"):
        return None
    found = False if name == "form" else None
    for key, value in _attributes(attributes):
        for token in value.split() if key in ("class", "id") else ():
            parts = _PART.findall(token)
            while len(parts) > 1 and parts[-1].isdigit():
                parts.pop()
            if not parts or parts[0] in _ABOUT:
                continue
            if parts[0] in _HINTS and len(parts) == 1:
                return True
            if parts[-1] in _HINTS or (name not in _MAIN and not _HINTS.isdisjoint(parts)):
                found = False
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    found: list[Block] = []
    text: list[str] = []
    linked = [0]
    stack: list[tuple[str, bool, bool, int]] = []  # element, out, main, suspect before it
    opened: Counter = Counter()
    suspects: list[Suspect] = []
    unclosed: set[str] = set()
    n_out = n_main = links = 0
    suspect = -1

    def close_block() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                share = min(1.0, linked[0] / max(1, len(joined)))
                found.append(Block(joined, share, n_main > 0, n_out > 0, suspect))
            text.clear()
        linked[0] = 0

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        tag = _TAG.match(page, lt) if lt >= 0 else None
        if lt < 0 or tag is None:
            end = len(page) if lt < 0 else lt + 1
            text.append(page[at:end])
            at = end
            continue
        if lt > at:
            piece = page[at:lt]
            text.append(piece)
            if links:
                linked[0] += len(piece.strip())
        at = max(tag.end(), lt + 1)
        closing, name, attributes = tag.group(1), (tag.group(2) or "").lower(), tag.group(3) or ""
        if not name:
            continue
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                stop = None
                if name not in unclosed:
                    stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                    if stop is None:  # nor is there one further on
                        unclosed.add(name)
                if stop:
                    at = stop.end()
                elif name == "head":  # may lack its end tag
                    stop = re.compile(r"(?=<body\b)", re.I).search(page, at)
                    at = stop.end() if stop else at
                elif name in _DRAWN:
                    stop = _BLOCK_TAG.search(page, at)
                    at = stop.start() if stop else len(page)
                else:
                    at = len(page)
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in _BLOCKS:
            shut = closing and any(x[0] == name for x in stack[-1:])
            span = name == "span" and attributes and not closing
            if not shut and not (span and (_is_out(name, attributes, n_main > 0) or _hinted(name, attributes) is not None)):
                continue
        close_block()
        links = 0
        if closing:
            gone = []
            while opened[name] and (not gone or gone[-1][0] != name):
                gone.append(stack.pop())
                opened[gone[-1][0]] -= 1
        else:
            gone = []
            while stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                gone.append(stack.pop())
                opened[gone[-1][0]] -= 1
        n_out -= sum(x[1] for x in gone)
        n_main -= sum(x[2] for x in gone)
        if gone:
            suspect = gone[-1][3]
        if not closing and name not in _VOID:
            hint = _hinted(name, attributes)
            is_main = name in _MAIN and hint is None
            stack.append((name, _is_out(name, attributes, n_main > 0), is_main, suspect))
            opened[name] += 1
            n_out += stack[-1][1]
            n_main += is_main
            if is_main and n_out == 0:
                at_suspect = suspect
                while at_suspect >= 0 and not suspects[at_suspect].holds_main:
                    suspects[at_suspect].holds_main = True
                    at_suspect = suspects[at_suspect].parent
            if hint is not None:
                suspects.append(Suspect(suspect, hint))
                suspect = len(suspects) - 1
    close_block()
    _judge(found, suspects)
    return found


def _judge(found: list[Block], suspects: list[Suspect]) -> None:
    """Marks the blocks of suspect elements that wrap neither article nor most text."""
    total = 0
    for block in found:
        total += len(block.text)
        if block.suspect >= 0:
            suspects[block.suspect].chars += len(block.text)
    for s in reversed(suspects):  # what an element holds, its parent holds
        if s.parent >= 0:
            suspects[s.parent].chars += s.chars
    out = []
    for s in suspects:
        wraps = s.holds_main or (not s.sure and 2 * s.chars > total)
        out.append(not wraps or (s.parent >= 0 and out[s.parent]))
    for block in found:
        block.out = block.out or (block.suspect >= 0 and out[block.suspect])


def first_pass(block: Block) -> bool | None:
    """In, out, or ambiguous."""
    if block.out or block.link_share > MOST_LINKS:
        return False
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))
    if block.inside:
        return True if len(block.text) >= SHORT or stops >= LEAST_STOPS_INSIDE and len(words) > 4 else None
    if len(block.text) < SHORT:
        return False if block.text[0] == "©" or words[0] == "copyright" else None
    if stops < LEAST_STOPS:
        return False if block.link_share > 0.2 or len(block.text) < LONG else None
    return True if len(block.text) >= LONG else None


def _is_text(block: Block) -> bool:
    """Mostly letters of any script, with few links."""
    signs = "".join(block.text.split())
    notice = signs[0] == "©" or block.text.lower().startswith("copyright")
    letters = sum(c.isalpha() or unicodedata.category(c)[0] == "M" for c in signs)
    return not (notice and len(block.text) < SHORT) and block.link_share <= FEW_LINKS and letters >= LEAST_LETTERS * len(signs)


def without_stop_words(found: list[Block], labels: list[bool | None]) -> list[bool | None]:
    """Labels of blocks of which the first pass took none in."""
    fits = [_is_text(b) for b in found]
    if not any(fits):
        return labels
    # the run of the greatest sum: text counts for it, other blocks against it
    best, run, total, start = None, (0, 0), 0, 0
    for i, (block, fit) in enumerate(zip(found, fits)):
        gain = len(block.text) if fit else -len(block.text)
        if i == 0 or total <= 0:
            total, start = 0, i
        total += gain
        if fit and (best is None or total > best):
            best, run = total, (start, i + 1)
    out: list[bool | None] = []
    for i, (block, fit, label) in enumerate(zip(found, fits, labels)):
        if fit and (len(block.text) >= SHORT or run[0] <= i < run[1]):
            out.append(True)
        else:
            out.append(None if fit else label)
    return out


def second_pass(labels: list[bool | None], inside: list[bool]) -> list[bool]:
    """Ambiguous blocks inherit from the nearest decided one of their part."""
    n = len(labels)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, seen in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, tuple[int, bool]] = {}
        for i in order:
            seen[i] = last.get(inside[i])
            if labels[i] is not None:
                last[inside[i]] = (i, labels[i])
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = [(abs(i - x[0]), x[1]) for x in (before[i], after[i]) if x]
            close = {kept for d, kept in near if d == min(near)[0]}
            label = close.pop() if len(close) == 1 else inside[i]
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if any(b.inside and not b.out for b in found):
        found = [b for b in found if b.inside]
    found = [b for b in found if not b.out]
    labels = [first_pass(b) for b in found]
    if True not in labels:
        labels = without_stop_words(found, labels)
    keep = second_pass(labels, [b.inside for b in found])
    return "\n".join(b.text for b, kept in zip(found, keep) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["text"] = [main_text(p) for p in part["html"]]
            yield part[["page_id", "url", "text"]]

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    done = rows.mapInPandas(batches, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
