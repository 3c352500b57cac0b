"""Operator 2: main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element.  A line's length is the length of its text; lines
in boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments), lines outside
the article where the page marks one, and lines that are mostly links have length 0.  Lengths are
summed over sliding windows of ``WINDOW`` lines; a surge point is a line where text begins whose
window reaches the threshold, the dive point is where the window sums fall to 0.  The text between
surge and dive points is kept, with the headings right before a surge, but for boilerplate lines.  In
a marked article any text is a surge; elsewhere ``SURGE`` characters are asked for, and a page that
nowhere reaches them is kept whole, so that short pages are not lost.

Character references are decoded, white space in a block becomes one space, blocks are joined by a
line end in page order.  Null, empty and text-free pages give an empty text.  Markup that is broken
or cut off is read as far as it goes.  Rows that repeat are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import read
from anomspark.llm.textnum import slices

WINDOW, SURGE, LINK_SHARE = 3, 80, 0.6

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
                   r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = frozenset("script style noscript template svg iframe object select textarea button title".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
#: Elements whose nesting is followed; the others end with the next block.
NESTED = BLOCK - frozenset("p li dd dt td th tr tbody thead tfoot hr html".split())
BOILER_TAGS = frozenset("nav aside footer form head menu dialog".split())
#: Class words of boilerplate; those of the second list are a site's furniture, but may name a part of an article.
_BOILER = ("ads?", r"advert\w*", "adsense", r"sponsor\w*", r"promo\w*", "menus?", r"nav\w*", "breadcrumbs?", r"sidebar\w*",
           r"widget\w*", "footer", "masthead", "topbar", "toolbar", "cookies?", "consent", "gdpr", "notices?",
           r"notification\w*", "popup", "modal", "overlay", "newsletter", r"subscri\w+", "signup", "login", "shar(?:e|ing)",
           "social", "comments?", "commentlist", "disqus", "repl(?:y|ies)", "related", r"recommend\w*", "pagination", "pager",
           r"skip\w*", "navigation", "contentinfo", "complementary", "site-?info")
_FURNITURE = ("banner", "header", "alert", "discussion", "copyright", "legal", "disclaimer", r"search\w*")
#: A heading is judged by where it stands; only these words make one boilerplate by themselves.
_HEADING = ("ads?", r"advert\w*", r"sponsor\w*", r"promo\w*", r"nav\w*", r"sidebar\w*", r"widget\w*", "newsletter", "comments?",
            "repl(?:y|ies)", "related", r"recommend\w*", "shar(?:e|ing)", "social")


def _any_word(*words: str) -> re.Pattern:
    return re.compile(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])", re.I)


BOILER_WORDS, ARTICLE_WORDS, HEADING_WORDS = _any_word(*_BOILER, *_FURNITURE), _any_word(*_BOILER), _any_word(*_HEADING)
MAIN_WORDS = re.compile(r"(?<![a-z])(?:article|content|main|post|entry|story|text)(?:[-_]?(?:body|content|text|main))?(?![a-z])", re.I)


def _names(attributes: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether it is hidden."""
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key in ("class", "id", "role"):
            names.append(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or \
                key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return " ".join(names), hidden


class Line:
    """One block: its text, whether it is boilerplate, in a marked article, a heading, and link characters."""

    __slots__ = ("text", "boiler", "inside", "heading", "links")

    def __init__(self, text: str, boiler: bool, inside: int, heading: bool, links: int):
        self.text, self.boiler, self.inside, self.heading, self.links = text, boiler, inside, heading, links


class Open:
    """The open elements, with counts of what is asked of them, so that no question walks the stack."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int]] = []  # element, boilerplate, mark of an article (2) or its likes (1)
        self.names: Counter = Counter()
        self.marks = [0, 0, 0]
        self.boiler = 0   # open boilerplate elements
        self.cleared = 0  # elements below this place count as plain text again

    def push(self, name: str, bad: bool, mark: int) -> None:
        self.stack.append((name, bad, mark))
        self.names[name] += 1
        self.marks[mark] += 1
        self.boiler += bad

    def close(self, name: str) -> None:
        """Closes the innermost element of this name and all inside it; nothing if none is open."""
        while self.names[name]:
            last, bad, mark = self.stack.pop()
            self.names[last] -= 1
            self.marks[mark] -= 1
            self.boiler -= bad and len(self.stack) >= self.cleared
            self.cleared = min(self.cleared, len(self.stack))
            if last == name:
                break

    def forgive(self) -> None:
        """What is open now is no boilerplate: a menu or the like that was never closed."""
        self.boiler, self.cleared = 0, len(self.stack)

    def mark(self) -> int:
        return 2 if self.marks[2] else 1 if self.marks[1] else 0


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    words: list[str] = []
    now = Open()
    block_boiler = heading = False
    links = in_link = at = 0

    def close() -> None:
        nonlocal links, block_boiler, heading
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            lines.append(Line(text, block_boiler or now.boiler > 0, now.mark(), heading, links))
        words.clear()
        links, block_boiler, heading = 0, False, False

    def add(text: str) -> None:
        nonlocal links
        if text:
            words.append(text)
            if in_link:
                links += len(text.strip())

    while (m := TOKEN.search(page, at)) is not None:
        add(page[at:m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCK:
                close()
                now.close(name)
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                stop = RAW_END[name].search(page, at)
                at = stop.start() if stop else len(page)
            add(" ")
            continue
        if name == "a":
            in_link += 1
        elif name == "br":
            add(" ")
        if name not in BLOCK:
            continue
        close()
        in_link = 0
        names, hidden = _names(attributes)
        article, title = name in ("article", "main"), name in HEADINGS
        mark = 2 if article else 1 if names and name in ("div", "section") and MAIN_WORDS.search(names) else 0
        own_header = name == "header" and now.marks[2] > 0
        named = HEADING_WORDS if title else ARTICLE_WORDS if now.marks[2] else BOILER_WORDS
        bad = hidden or name in BOILER_TAGS or name == "header" and not own_header or \
            name not in ("html", "body", "main") and not (mark and not article and not _comments(names)) and \
            bool(names) and not own_header and named.search(names) is not None
        if article and not bad and not now.names["comments"]:
            now.forgive()
        heading = title
        if name in NESTED and not title:
            now.push(name, bad, mark)
            if bad and _comments(names):
                now.push("comments", True, 0)
        else:
            block_boiler = bad
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")
        add(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest)
    close()
    return lines


def _comments(names: str) -> bool:
    return re.search(r"(?<![a-z])(?:comment|disqus|discussion|repl(?:y|ies))", names, re.I) is not None


def main_text(page: str | None) -> str:
    lines = lines_of(page) if page else []
    best = max((x.inside for x in lines if not x.boiler), default=0)
    length = np.array([0 if x.boiler or x.inside < best or not best and x.links > LINK_SHARE * len(x.text)
                       else len(x.text) for x in lines], np.int64)
    if not length.any():
        return "\n".join(x.text for x in lines if not x.boiler)
    padded = np.concatenate((np.zeros(WINDOW - 1, np.int64), length, np.zeros(WINDOW - 1, np.int64)))
    ahead = np.convolve(padded, np.ones(WINDOW, np.int64), "valid")[WINDOW - 1:]  # this line and the next
    least = 1 if best else SURGE
    if ahead.max() < least:
        least = 1
    keep, i, n = np.zeros(len(lines), bool), 0, len(lines)
    while i < n:
        if length[i] and ahead[i] >= least:  # surge
            start = i
            while start and lines[start - 1].heading and length[start - 1] and not keep[start - 1]:
                start -= 1
            while i < n and ahead[i]:  # until the dive
                i += 1
            keep[start:i] = True
        else:
            i += 1
    return "\n".join(x.text for x, k, v in zip(lines, keep, length, strict=True) if k and v)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "page"):
        text = [main_text(x) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string())], names=[*b.schema.names[1:], "text"])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of ``pages`` and the main ``text``."""
    rows = pages.select(F.col(html_col).alias("page"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    fields = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return rows.mapInArrow(_extract, f"{fields}, text string").toDF(*keep, "text")


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
