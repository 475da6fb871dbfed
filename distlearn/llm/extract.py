"""Main text of web pages: the stretch of the page with the largest sum of word and tag weights.

A page is a sequence of words and tags. Words count for a stretch, tags against it, each kind by a
weight learned from pages that mark their article themselves (article or main elements): the log of
how much more often the kind stands inside the mark than outside, held positive for words and negative
for tags. One linear scan finds the stretch with the largest sum. Elements that are never part of an
article (navigation, adverts, forms, scripts, comments by readers ...) are one tag to the scan and leave
no text. Where only a class, an id or a role says so, and the element holds the page's article nevertheless, it
stays (see ``events``).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 4_000  # about so many pages, drawn by a hash of the id, teach the weights

_WHOLE = r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|object|button)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>"
_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(%s)>|(<(?:/?[a-zA-Z]|[!?]))"  # the last group: a tag without an end
# a quote opens a value right after "=" only; a value may have any length and hold ">"
_QUOTED = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+"""
TOKEN = re.compile(f"{_WHOLE}|{_TAG % _QUOTED}", re.S | re.I)
PLAIN = re.compile(f"{_WHOLE}|{_TAG % '[^>]*+'}", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form fieldset dialog menu".split())
MARKS = frozenset(("article", "main"))
SELF_CLOSING = frozenset("p li dd dt".split())  # an open one ends where the next block starts
KNOWN = INLINE | VOID | NEVER | MARKS | SELF_CLOSING | frozenset(
    "html body header section div address blockquote center dl figure figcaption h1 h2 h3 h4 h5 h6 ol ul pre table thead tbody tfoot tr td th caption details summary title".split()
)
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus respond reply replies share sharing "
    "social related recommended recommendations newsletter subscribe signup login search widget toolbar pagination pager copyright disclaimer alert".split()
)
DENIED = frozenset("no non not has have with without".split())  # before a hint: the element is about it, not it
WRAPS = frozenset("form fieldset".split())  # some pages put all they have into one
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

WORD, TAG = "word ", "tag "
WORD_RANGE, TAG_RANGE = (0.05, 2.0), (-2.0, -0.05)
SKIPPED = TAG + "skipped"
OPENED = 50  # elements with a hint, one around the other, that hold the article: more of them tell nothing


def attributes_of(written: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(written):
        out.setdefault(name.lower(), "".join(values))
    return out


def hinted(value: str) -> bool:
    """True if a class or id names something beside the article; "no-comments" and "has-sidebar" don't."""
    for name in value.split():
        before = ""
        for part in map(str.lower, PARTS.findall(name)):
            if part in HINTS and before not in DENIED:
                return True
            before = part
    return False


def boilerplate(name: str, written: str, in_article: bool) -> str:
    """"never" for elements that hold no article text by their name or because they are hidden, "hint" for those that likely hold none.

    Hints are the role, class and id, and forms; ``events`` opens an element with a hint that holds the article after all.
    """
    if name in WRAPS:
        return "hint"
    if name in NEVER or (name == "header" and not in_article):
        return "never"
    if not written:
        return ""
    found = attributes_of(written)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or NO_DISPLAY.search(found.get("style", "")):
        return "never"
    if name in ("html", "body") or name in MARKS:
        return ""
    if found.get("role", "").lower() in ROLES or hinted(found.get("class", "")) or hinted(found.get("id", "")):
        return "hint"
    return ""


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(name, closing, attributes, text): tags have a name, texts have none; scripts, comments and declarations are "!".

    Time grows with the length of the page. From a tag on whose quoted value never ends, quotes are characters
    like others; from a tag on that never ends, the rest is text.
    """
    at, pattern, start = 0, TOKEN, 0
    while m := pattern.search(page, start):
        if m[5] is not None:  # no end of this tag
            if pattern is PLAIN:
                break
            pattern, start = PLAIN, m.start()
            continue
        if m.start() > at:
            yield "", False, "", page[at : m.start()]
        at = start = m.end()
        if m[3]:
            yield m[3].lower(), bool(m[2]), m[4], ""
        else:
            yield "!", False, m[1].lower() if m[1] else "", ""
    if at < len(page):
        yield "", False, "", page[at:]


def _outline(page: str, opened: frozenset[int], trusting: bool = True) -> tuple[list[tuple[str, str, bool, bool]], dict[int, list[int]]]:
    """Events of a page, and what was skipped by a hint: token -> [words, of headings h1].

    Tokens in ``opened`` are not skipped, and no hint counts unless ``trusting``.
    """
    out: list[tuple[str, str, bool, bool]] = []
    held: dict[int, list[int]] = {}
    skip, depth, marked, block, breaks, since = "", 0, 0, "body", True, -1
    for at, (name, closing, written, text) in enumerate(tokens(page)):
        if not name:
            if not skip:
                out.append((WORD + block, text, breaks, marked > 0))
                breaks = False
            elif since in held:
                held[since][0] += len(text.split())
            continue
        if name == "!":
            if written in ("select", "textarea", "iframe", "object"):
                breaks = True
            continue
        if skip:
            if name == "h1" and not closing and since in held:
                held[since][1] += 1
            if name in MARKS or name == "body":
                skip = ""
            elif name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
                continue
            elif skip in SELF_CLOSING and not closing and name not in INLINE and name not in VOID:
                skip = ""
            else:
                continue
        if not closing and name not in VOID and at not in opened:
            why = boilerplate(name, written, marked > 0)
            if why == "never" or (why and trusting):
                skip, depth, breaks, since = name, 1, breaks or name not in INLINE, at
                if why == "hint":
                    held[at] = [0, 0]
                out.append((SKIPPED, "", breaks, marked > 0))
                continue
        if name in MARKS:
            marked = max(0, marked + (-1 if closing else 1))
        if name not in INLINE:
            breaks = True
            if name not in VOID:
                block = "body" if closing else (name if name in KNOWN else "other")
        out.append((TAG + (name if name in KNOWN else "other"), "", breaks, marked > 0))
    return out, held


def events(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, starts a new block, inside a mark) for each tag, skipped element and text.

    Tags have no text. Within a skipped element nothing is reported; it ends at its end tag, and an
    article or main element ends it too, so a missing end tag cannot swallow the page. An element skipped by a hint
    is opened if it holds more words than all that is left and either the page's first-level heading, where nothing
    left has one, or all words there are. Each time one is opened the page is read again; on a page that has OPENED of
    them around each other no hint counts any more.
    """
    opened: frozenset[int] = frozenset()
    while True:
        out, held = _outline(page, opened)
        if not held:
            return out
        at = max(held, key=lambda i: (held[i][0], -i))
        words, headings = held[at]
        left = sum(len(e[1].split()) for e in out)
        if words <= left or (left and not (headings and all(e[0] != TAG + "h1" for e in out))):
            return out
        if len(opened) == OPENED:
            return _outline(page, opened, False)[0]
        opened |= {at}


def count_kinds(page: str, inside: Counter, outside: Counter) -> None:
    """Add a page that marks its article: how often each kind stands in and out of the mark."""
    found = events(page)
    if not any(marked for *_, marked in found):
        return
    for kind, text, _, marked in found:
        (inside if marked else outside)[kind] += len(text.split()) if kind.startswith(WORD) else 1


def learned(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of kinds from their counts (inside, outside)."""
    out = {}
    for kind, (a, b) in counts.items():
        low, high = WORD_RANGE if kind.startswith(WORD) else TAG_RANGE
        out[kind] = min(high, max(low, math.log((a + 1) / (b + 1))))
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the largest sum; the first and longest of equals."""
    best, start, end, total, since = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, since = 0.0, i
        total += s
        if total > best or (total == best and since == start and end):
            best, start, end = total, since, i + 1
    return start, end


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The article text of one page; white space is one space, blocks are joined by one space."""
    found = [e for e in events(page or "") if not e[0].startswith(WORD) or e[1].strip() or e[2]]
    scores = []
    for kind, text, *_ in found:
        if kind.startswith(WORD):
            scores.append(len(text.split()) * weights.get(kind, 1.0))
        else:
            scores.append(weights.get(kind, -0.5))
    start, end = best_stretch(scores)
    parts = []
    for kind, text, breaks, _ in found[start:end]:
        if breaks:
            parts.append(" ")
        parts.append(entities.unescape(text) if "&" in text else text)
    return " ".join("".join(parts).split())


def learn_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from about ``sample`` pages, drawn by a hash of page_id; counts are summed by Spark."""
    total = pages.count()
    drawn = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, total // sample))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                count_kinds(page or "", inside, outside)
        kinds = sorted(inside | outside)
        yield pa.RecordBatch.from_pydict(
            {"kind": pa.array(kinds, pa.string()), "a": pa.array([inside[k] for k in kinds], pa.int64()), "b": pa.array([outside[k] for k in kinds], pa.int64())}
        )

    rows = drawn.select("html").mapInArrow(run, "kind string, a long, b long").groupBy("kind").agg(F.sum("a"), F.sum("b")).collect()
    return learned({kind: (a, b) for kind, a, b in rows})  # one row per kind of tag


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per page, in one pass without a shuffle.

    A null or empty page, and one without words, has an empty text. Repeated rows are extracted each
    for itself; an empty table gives an empty result; other columns are not read.
    """
    weights = learn_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
