"""Main text of web pages by tag-path ratios.

A page's text runs are gathered into blocks, each with its root-to-leaf path of
block tags. Text length and punctuation are summed per path; the ratios (per block)
are put back on the sequence of blocks, smoothed over neighbours, fused into one
value and averaged per path again. Paths of menus, headers, footers, sidebars, notices,
adverts, forms and comments, as tags and class words tell them, count for a small part of
that. Paths with a value above a share of the page's greatest are content, and the values
alone decide where the article is: it is the smallest element with most of what content
paths are worth, grown while what it grows by is content too, or up to its own article or
main element. Every block of it is kept, whole, unless its path is below the threshold and
either marked as said or in an element of its own that is mostly links.

Defined cases: null or empty html gives empty text and 0 characters; a page without
content blocks the same; broken or unclosed markup is read as far as it goes;
repeated rows give equal rows; extra columns pass by.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import textkernel as K

#: Tag names of the HTML standard by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg noembed noframes object annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rb rt rp nobr blink center math mi mn mo ms mrow mtext msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mspace mpadded mphantom menclose mmultiscripts mtable mtr mtd semantics".split())
APART = frozenset("nav header footer aside form button select option menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Opening the key ends an open element of its set, up to the nearest list or table.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
#: Elements that shape text within a container and are none themselves.
SHAPES = frozenset("p li ul ol dl dt dd blockquote pre td th tr tbody thead table figure figcaption".split()) | HEADINGS
#: Elements that hold the whole page.
PAGE = frozenset("html body".split())
SCOPES = frozenset("ul ol dl table body html".split())
#: Words in class, id and role that mark what stands around an article.
AROUND = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header legal login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget complementary contentinfo alert alertdialog".split()
)
#: First parts of class names that tell of a page's state, not of an element's kind.
STATES = frozenset("has with without no is".split())

#: What the value of a path that stands around an article counts for.
PRIOR = 1e-3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_around(tag: str, attrs: str) -> bool:
    if tag in APART:
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if parts[0] not in STATES and not AROUND.isdisjoint(parts):
                    return True
    return False


class Block:
    __slots__ = ("path", "text", "linked", "around", "main", "within")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, around: bool, main: bool, within: tuple[int, ...]):
        self.path, self.text, self.linked, self.around, self.main, self.within = path, text, linked, around, main, within

    @property
    def kind(self) -> tuple[tuple[str, ...], bool]:
        """What has a value of its own: a path, and whether it stands around the article."""
        return self.path, self.around

    def container(self) -> tuple[int, ...]:
        """The elements down to the one that holds the block beside others."""
        end = len(self.path)
        while end and self.path[end - 1] in SHAPES:
            end -= 1
        return self.within[:end]


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, whether it stands around the article, where it opens
    runs: list[str] = []
    linked, n_link = [0], [0]

    def flush() -> None:
        if runs:
            text = _SPACE.sub(" ", html.unescape("".join(runs))).strip()
            runs.clear()
            if text:
                tags = [t for t, *_ in stack]
                path = tuple(t for t in tags if t not in INLINE)
                within = tuple(k for t, _, k in stack if t not in INLINE)
                heading = bool(HEADINGS.intersection(path))
                inside = next((i for i, t in enumerate(tags) if t in MAIN), None)
                kept_header = heading and inside is not None
                around = any(a and not (kept_header and t == "header" and i > inside) for i, (t, a, _) in enumerate(stack))
                out.append(Block(path, text, linked[0], around, inside is not None, within))
            linked[0] = 0

    def pop_to(i: int) -> None:
        for tag, *_ in stack[i:]:
            n_link[0] -= tag == "a"
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            runs.append(text)
            if n_link[0]:
                linked[0] += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            runs.append(html.escape(m[1]))
        if not m[3]:
            continue
        tag, attrs = m[3].lower(), m[4]
        if m[2]:
            if tag == "br":
                runs.append(" ")
                continue
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if i is None:
                if tag == "p":
                    flush()
                continue
            if tag not in INLINE:
                flush()
                pop_to(i)
            elif all(t in INLINE for t, *_ in stack[i:]):  # an inline end tag closes no block
                n_link[0] -= tag == "a"
                del stack[i]
            continue
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag not in ("object",):
                at = end.end() if end else n
            continue
        if tag == "xmp":  # shown as it stands
            end = re.compile(r"</xmp\s*>", re.I).search(page, at)
            flush()
            runs.append(html.escape(page[at : end.start() if end else n]))
            flush()
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "br":
                runs.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if tag in SIBLINGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in SCOPES:
                        break
                    if stack[i][0] in SIBLINGS[tag]:
                        pop_to(i)
                        break
        around = _is_around(tag, attrs)
        if tag in INLINE and around:
            around = any(k in attrs.lower() for k in ("hidden", "display"))
        stack.append((tag, around, m.start()))
        n_link[0] += tag == "a"
    flush()
    return out


def path_values(found: list[Block], width: float = 1.0) -> dict[tuple[tuple[str, ...], bool], float]:
    """The fused, smoothed ratio of each tag path."""
    length, points, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in found:
        length[b.kind] += max(0, len(b.text) - b.linked)
        points[b.kind] += len(_PUNCT.findall(b.text))
        count[b.kind] += 1
    by_text = np.array([length[b.kind] / count[b.kind] for b in found])
    by_point = np.array([points[b.kind] / count[b.kind] for b in found])
    around = np.arange(-2, 3)
    kernel = np.exp(-(around**2) / (2 * width**2))
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")
    fused = smooth(by_text) * (1 + smooth(by_point))
    total = defaultdict(float)
    for b, v in zip(found, fused):
        total[b.kind] += v
    return {k: total[k] / count[k] * (PRIOR if k[1] else 1.0) for k in count}


def main_text(page: str | None, strength: float = 0.5, share: float = 0.9) -> str:
    """The page's content blocks, joined by newlines.

    strength: the threshold, as a part of the greatest path value; share: of the content paths' values that the article has.
    """
    found = blocks(page or "")
    if all(b.around for b in found):
        return ""
    value = path_values(found)
    least = strength * max(value.values())
    strong = [b for b in found if value[b.kind] >= least]
    home, tag = _home(strong, value, share)
    kept = [b for b in found if b.within[: len(home)] == home and (value[b.kind] >= least or not b.around)]
    whole = tag is None or tag in PAGE
    if whole:
        # An article that is not in one element: what article and main elements hold, if they hold that much.
        worth = lambda some: sum(value[b.kind] for b in some)
        if worth(b for b in strong if b.main) >= share * worth(strong) > 0:
            kept = [b for b in kept if b.main or b.around]
    # A container with text above the threshold, or around such text, is no list of links.
    full = {b.container()[:k] for b in strong for k in range(len(b.container()) + 1)}
    own = lambda b: not whole and b.container() == home
    weak = defaultdict(list)
    for b in kept:
        if value[b.kind] < least and not own(b):
            where = b.container()
            weak[where if where not in full else (where, b.path)].append(b)
    links = {id(b) for group in weak.values() if _is_linked(group) for b in group}
    return "\n".join(b.text for b in kept if id(b) not in links)


def _home(strong: list[Block], value: dict, share: float) -> tuple[tuple[int, ...], str | None]:
    """The element that is the article, by what the content blocks are worth, and its tag."""
    worth, tags = defaultdict(float), {}
    for b in strong:
        place = b.container()
        for k in range(len(place) + 1):
            worth[place[:k]] += value[b.kind] * (1 - b.linked / len(b.text))
            tags[place[:k]] = b.path[:k]
    home = max((c for c in worth if worth[c] >= share * worth[()]), key=len)  # of texts without links
    while len(home) > 1 and tags[home[:-1]][-1] not in PAGE:
        if MAIN.isdisjoint(tags[home[:-1]]) and worth[home[:-1]] <= worth[home]:
            break  # nothing more to gain, and no article or main element to fill
        home = home[:-1]
    return home, (tags[home][-1] if home else None)


def _is_linked(group: list[Block]) -> bool:
    return sum(b.linked for b in group) >= 0.5 * sum(len(b.text) for b in group)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page's whole html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(K.tidy(run), SCHEMA)
