"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each with its path of block elements from the root. Text length and punctuation are
summed by path and divided by its blocks; both ratios are smoothed over the blocks in page order, fused, and averaged
again by path; paths above a share of the best are content. The smallest element that holds all blocks of the content
paths is the article: its other blocks (headings, short lists) belong to it unless they are mostly links.

Elements that never hold an article (menus, footers, scripts, controls) are left out before anything is counted, and so are
forms, but for one that holds an article or main element or half of the page's text: that is a plain division. A class, id
or role that names adverts, notices, comments and the like is a weight in the fused score (ODD_NAME for each such element
around a block), so a page whose article stands in such an element keeps it; beside the article it keeps blocks out.

Defined results: null or empty html gives an empty text; text without any element is one block; broken or cut-off markup
is read as far as it goes, a comment that is never closed to the end of the page; paths that score alike are alike;
repeated rows keep their own result; an empty table gives no rows; further columns are ignored. Time is proportional to a
page's length, whatever its depth.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import python_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
#: Elements left out with all they hold.
OUT = frozenset("head title script style noscript template iframe object svg canvas math nav footer aside form button select textarea input option menu dialog audio video".split())
#: Words of a class, id or role by which an element is no article, unless they come with one of STATES (no-sidebar,
#: comments-open) or the element holds the article.
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond replies share sharing social related recommended widget login search pagination pager hidden".split()
)
STATES = frozenset("no not has with without open opened closed enabled disabled allowed layout on off".split())
#: What each such element counts for on the way from the root to a block.
ODD_NAME = 0.01
#: A block's start ends an open paragraph.
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
_SAME = {"li": ("li",), "dt": ("dd", "dt"), "dd": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = ("div", "article", "section", "td", "li", "blockquote", "body", "main", "form", "nav", "footer", "aside", "header")
_ENDS_SAME = ("ul", "ol", "dl", "table", "tbody", "thead", "div", "select", "article", "section")
_ENDS_INLINE = ("p", "div", "li", "td", "article", "section", "body")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TAG = re.compile(r"<[A-Za-z/!?]")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：،؛؟¡¿]")
#: A path is content from this share of the best path's score on.
SHARE = 0.15
#: Weights of a block, its neighbours and theirs.
KERNEL = (0.4, 0.24, 0.06)
LINKS = 0.5


def _says_out(name: str) -> bool:
    """Whether one class name (or id, or role) names something that is no article."""
    parts = set(re.split(r"[^a-z0-9]+", name))
    return not parts.isdisjoint(OUT_NAMES) and parts.isdisjoint(STATES)


class _Reader(HTMLParser):
    """Elements numbered in page order and blocks of text, in time proportional to the page.

    For each block element: number of its parent, of the last element in it, path (its name and its parent's path, as one
    number), whether its class names something that is no article. For each block: [text pieces, element, length of link
    text].
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # elements in the stack: (name, number, left out, number of the block element that text in it belongs to)
        self.stack: list[tuple[str, int, bool, int]] = []
        self.where: dict[str, list[int]] = defaultdict(list)  # places in the stack, by element
        self.parent, self.last, self.path, self.depth = [0], [0], [0], [0]
        self.tag, self.odd = [""], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[list] = []
        self.fresh = True
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in VOID:
            return
        if tag not in INLINE:
            self.fresh = True
            if tag in _CLOSES_P:
                self._close(("p",), _ENDS_P)
            if tag in _SAME:
                self._close(_SAME[tag], _ENDS_SAME)
        out = bool(self.stack and self.stack[-1][2]) or tag in OUT or tag == "header" and not self.where["article"] and not self.where["main"]
        up = self.stack[-1][3] if self.stack else 0
        number = up
        if tag not in INLINE:
            number = len(self.parent)
            names = [v for k, v in attrs if k in ("class", "id", "role") and v]
            first = names[0].split()[:1] if names else []
            key = (self.path[up], ".".join([tag, *first]))
            self.parent.append(up)
            self.last.append(number)
            self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
            self.depth.append(self.depth[up] + 1)
            self.tag.append(tag)
            self.odd.append(tag not in ("html", "body", "main") and any(map(_says_out, " ".join(names).lower().split())))
        if tag == "a":
            self.links += 1
        self.where[tag].append(len(self.stack))
        self.stack.append((tag, number, out, number))

    def _top(self, tags: tuple[str, ...]) -> int:
        return max((self.where[t][-1] for t in tags if self.where[t]), default=-1)

    def _close(self, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Ends the last open one of tags with all in it, unless one of stop was opened after it."""
        k = self._top(tags)
        if k < 0 or k < self._top(stop):
            return
        for tag, number, _, _ in reversed(self.stack[k:]):
            self.where[tag].pop()
            self.links -= tag == "a"
            if tag not in INLINE:
                self.last[number] = len(self.parent) - 1
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.fresh = True
        self._close((tag,), () if tag not in INLINE else _ENDS_INLINE)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        if self.fresh:
            if not data.strip():
                return
            self.blocks.append([[], self.stack[-1][3] if self.stack else 0, 0])
            self.fresh = False
        self.blocks[-1][0].append(data)
        if self.links > 0:
            self.blocks[-1][2] += len(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment that is never closed goes on to the end (inside scripts and styles none begins)."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)  # as browsers do: a comment up to there
        return end + 1 if end >= 0 else len(self.rawdata)

    def finish(self) -> None:
        self.close()
        for tag, number, _, _ in self.stack:
            if tag not in INLINE:
                self.last[number] = len(self.parent) - 1
        self.last[0] = len(self.parent) - 1

    def odd_names(self) -> list[int]:
        """For each element, how many elements from the root to it are named like something that is no article.

        An element's name says nothing if the element holds main, h1, or every article that isn't named so itself.
        """
        plain = [k for k, t in enumerate(self.tag) if t == "article" and not self.odd[k]]
        inner = [k for k, t in enumerate(self.tag) if t in ("main", "h1")]
        out = [0] * len(self.parent)
        for k in range(1, len(out)):
            odd = self.odd[k]
            if odd:
                at = bisect_right(inner, k)
                odd = not (at < len(inner) and inner[at] <= self.last[k] or plain and k < plain[0] and plain[-1] <= self.last[k])
            out[k] = out[self.parent[k]] + odd
        return out


def _smooth(x: np.ndarray) -> np.ndarray:
    out = KERNEL[0] * x
    for k, w in enumerate(KERNEL[1:], 1):
        out[k:] += w * x[:-k]
        out[:-k] += w * x[k:]
    return out


def _whole_tags(html: str) -> str:
    """html without a tag that is never ended: after the last > nothing that looks like one can be."""
    cut = _TAG.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


_FORM = re.compile(r"<form(?=[\s>/])(.*?)(</form\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.IGNORECASE | re.DOTALL)


def _page_forms(html: str) -> str:
    """html with forms that hold the page itself as plain divisions: an article, a main element or half of all text."""

    def size(part: str) -> int:
        return len(_MARKUP.sub("", part))

    whole = None

    def one(m: re.Match) -> str:
        nonlocal whole
        if not re.search(r"<(article|main)\b", m[1], re.IGNORECASE):
            whole = size(html) if whole is None else whole
            if 2 * size(m[1]) < whole:
                return m[0]
        return f"<div{m[1]}{'</div>' if m[2] else ''}"

    return _FORM.sub(one, html)


def main_text(html: str | None) -> str:
    reader = _Reader()
    reader.feed(_page_forms(_whole_tags(html or "")))
    reader.finish()
    blocks = [(" ".join("".join(parts).split()), at, links) for parts, at, links in reader.blocks]
    in_header = [False] * len(reader.parent)
    for k in range(1, len(in_header)):
        in_header[k] = in_header[reader.parent[k]] or reader.tag[k] == "header"
    # in a header inside the article only headings are its text
    blocks = [b for b in blocks if b[0] and not (in_header[b[1]] and reader.tag[b[1]] not in _HEADINGS)]
    if not blocks:
        return ""
    odd, path_of = reader.odd_names(), reader.path
    # blocks of a path under elements with and without such names are told apart
    path = [(path_of[at], odd[at]) for _, at, _ in blocks]
    length, points, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for (text, _, links), p in zip(blocks, path, strict=True):
        length[p] += max(0, len(text) - links)
        points[p] += len(PUNCTUATION.findall(text))
        count[p] += 1
    by_block = lambda total: _smooth(np.array([total[p] / count[p] for p in path], float))
    fused = np.log1p(by_block(length)) * (1 + np.log1p(by_block(points)))
    score = defaultdict(float)
    for p, f in zip(path, fused, strict=True):
        score[p] += f * length[p] / count[p] ** 2 * ODD_NAME ** p[1]
    best = max(score.values())
    content = {p for p, s in score.items() if s >= SHARE * best and length[p]}
    held = [reader.parent[at] for (_, at, _), p in zip(blocks, path, strict=True) if p in content]
    # the smallest element that holds them all: from the first one up
    holds, last = min(held, default=0), max(held, default=0)
    while last > reader.last[holds]:
        holds = reader.parent[holds]
    inside = lambda at: holds <= at <= reader.last[holds]
    return "\n".join(text for (text, at, links), p in zip(blocks, path, strict=True) if inside(at) and (p in content or links < LINKS * len(text) and odd[at] <= odd[holds]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    python_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
