"""Main text of web pages by tree scoring.

The page becomes a tree. Each paragraph earns points for its length and commas and passes them to
its ancestors, less the farther they are; a container's points are discounted by its share of link
text. The best container is widened to its nearest article or main element, of which only junk and
parts of links are dropped; it is kept with those siblings that read like part of the same article.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")

RAW = frozenset("script style noscript template textarea title iframe svg object canvas annotation annotation-xml".split())
JUNK_TAGS = frozenset("head nav footer aside form button select option dialog menu audio video map".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Siblings of the best container in the page's body that are kept unless they are links.
READS_ON = HEADINGS | frozenset("p ul ol dl pre blockquote table figure".split())
#: Junk words of what readers write; elements of such a name are never prose of the article.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Words in class, id or role that mark what isn't the article.
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words beside a junk word that leave a name what it is ("comment-list", "ad-slot").
PLAIN_WORDS = frozenset("area article articles bar block body bottom box btn button buttons container content discussion footer form global header icon icons inner item items left link links list main nav outer page panel post primary reader readers right row section secondary site slot stories story text thread threads title top unit user users wrap wrapper".split())
#: A start tag ends these open elements, up to the nearest scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
WEIGHT = {"article": 1.5, "main": 1.3, "section": 1.1, "body": 0.9, "td": 0.9, "li": 0.7, "ul": 0.7, "ol": 0.7, "html": 0.5}


def _is_junk(tag: str, attributes: str, inside: bool = False) -> int:
    """2: junk; 3: junk unless it turns out to hold most of the page's text; 1: the same, or prose
    (in an article); 0: not junk.

    Forms are doubtful, as some pages stand in one, and so are elements whose names say more than a
    junk word ("with-sidebar", "no-comments"). Headings are never junk by name, paragraphs only by a
    name of junk words, and sections of an article only if a whole name is one.
    """
    if tag in JUNK_TAGS:
        return 3 if tag == "form" else 2
    if not attributes:
        return 0
    if tag not in ("html", "body") and _HIDDEN.search(attributes):
        return 2
    if tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return 0
    doubtful = 0
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORD.findall(name)
            if name in JUNK_WORDS:
                return 2
            if JUNK_WORDS.isdisjoint(words) or (inside and tag == "section"):
                continue
            if all(w in JUNK_WORDS or w in PLAIN_WORDS for w in words):
                return 2
            prose = inside and READERS.isdisjoint(words)
            doubtful = 0 if tag == "p" else max(doubtful, 1 if prose else 3)
    return doubtful


class Page:
    """Nodes in page order with their parents, and blocks of text with the node that holds each.

    Junk has no blocks. Depths of open elements are kept by name, so that a tag finds what it closes
    at once, however deep the page is nested.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.junk, self.doubt = ["#"], [-1], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [0]
        self._depths: dict[str, list[int]] = {}
        self._open_blocks: list[int] = []
        self._pieces: list[str] = []
        self._linked = 0
        self._articles = 0
        self._read(html)
        self._settle()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each node: characters of text below it, and how many of them are links."""
        chars, linked = [0] * len(self.tag), [0] * len(self.tag)
        for node, text, links in self.blocks:
            chars[node] += len(text)
            linked[node] += links
        for node in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
            linked[self.parent[node]] += linked[node]
        return np.array(chars, np.int64), np.array(linked, np.int64)

    def _settle(self) -> None:
        """Drops the blocks of doubtful elements that hold no more than half of the text outside junk,
        and aren't prose either: in an article, sentences that aren't links."""
        if not any(self.doubt):
            return
        chars, linked = self.sums()
        said = [False] * len(self.tag)
        for node, text, links in self.blocks:
            said[node] |= len(text) >= 25 and 2 * links < len(text) and any(c in ".,;:!?。，" for c in text)
        for node in range(len(self.tag) - 1, 0, -1):
            said[self.parent[node]] |= said[node]
        gone = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            d = self.doubt[node]
            prose = d == 1 and said[node] and 3 * linked[node] < chars[node]
            gone[node] = gone[self.parent[node]] or (d > 0 and 2 * chars[node] <= chars[0] and not prose)
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def _text(self, raw: str) -> None:
        if raw and not self.junk[self._open[-1]]:
            self._pieces.append(raw)
            if self._depths.get("a"):
                self._linked += len(raw)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join(unescape("".join(self._pieces)).split())
            if text:
                node = self._open[self._open_blocks[-1]] if self._open_blocks else 0
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._pieces = []
        self._linked = 0

    def _pop_to(self, depth: int) -> None:
        while len(self._open) > depth:
            tag = self.tag[self._open.pop()]
            self._depths[tag].pop()
            self._articles -= tag in ("article", "main")
            if tag in BLOCK:
                self._open_blocks.pop()

    def _depth(self, names) -> int:
        """Depth of the innermost open element of one of the names; 0 if none is open."""
        return max((d[-1] for n in names if (d := self._depths.get(n))), default=0)

    def _close(self, names, scope) -> None:
        depth = self._depth(names)
        if depth > self._depth(scope):
            self._flush()
            self._pop_to(depth)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self._pieces.append(" ")
                if tag == "hr":
                    self._flush()
            return
        if tag in BLOCK:
            self._flush()
            last = self._open_blocks[-1] if self._open_blocks else 0
            if self.tag[self._open[last]] == "p" and self._depth(("button",)) < last:
                self._flush()
                self._pop_to(last)
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        elif tag == "a":
            self._close({"a"}, {"td", "th", "table"})
        up = self._open[-1]
        inside = self._articles > 0
        kind = 2 if self.junk[up] or (tag == "header" and not inside) else _is_junk(tag, attributes, inside)
        self.tag.append(tag)
        self.parent.append(up)
        self.junk.append(kind == 2)
        self.doubt.append(kind % 2 and kind)
        self._depths.setdefault(tag, []).append(len(self._open))
        if tag in BLOCK:
            self._open_blocks.append(len(self._open))
        self._articles += tag in ("article", "main")
        self._open.append(len(self.tag) - 1)

    def _end(self, tag: str) -> None:
        depth = self._depth((tag,))
        holds_block = bool(self._open_blocks) and self._open_blocks[-1] >= depth
        if not depth or (holds_block and tag not in BLOCK):  # an inline end tag does not close blocks
            return
        if holds_block:
            self._flush()
        self._pop_to(depth)

    def _read(self, html: str) -> None:
        at, last, find = 0, html.rfind(">") + 1, _TAG.search  # no tag ends behind the last >
        while m := find(html, at, last):
            self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                if not m[0].endswith(">"):
                    at = len(html)  # never closed
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    at = self._raw_end(html, tag, at)
            else:
                self._start(tag, m[3])
        rest = _UNFINISHED.search(html, max(at, last))
        self._text(html[at : rest.start() if rest else len(html)])
        self._flush()

    @staticmethod
    def _raw_end(html: str, tag: str, at: int) -> int:
        """Where an element whose content is no markup ends: with the page, if it is never closed."""
        end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
        return end.end() if end else len(html)


def _scores(page: Page, chars: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Points that paragraphs pass to their ancestors, discounted by link density."""
    tag, parent, points = page.tag, page.parent, np.zeros(len(page.tag))
    for node, text, links in page.blocks:
        if tag[node] in HEADINGS:
            continue
        worth = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 if len(text) >= 25 else 0.2) * (1 - links / len(text))
        holder = parent[node] if tag[node] not in ("body", "article", "main", "#") else node
        share, level = 1.0, 0
        while holder > 0 and level < 5:
            points[holder] += worth * share
            holder, level = parent[holder], level + 1
            share = 0.5 if level == 1 else 1 / (3 * level)
    return points * (1 - linked / np.maximum(chars, 1)) * np.array([WEIGHT.get(t, 1.0) for t in tag])


def _link_list(page: Page, node: int, items: list[int], chars, linked) -> bool:
    """A list of links that lead away: hardly any other text, and no references: those are numbered,
    or hold a sentence's marks or sixty characters an item."""
    if page.tag[node] != "ul" or linked[node] <= 0.66 * chars[node]:
        return False
    marks, n = items[0], max(1, items[1])
    return marks < n and chars[node] < 60 * n


def main_blocks(page: Page) -> list[str]:
    """The texts of the blocks of the best container and its kept siblings, in page order."""
    blocks, tag, parent = page.blocks, page.tag, page.parent
    if not blocks:
        return []
    n = len(tag)
    chars, linked = page.sums()
    score = _scores(page, chars, linked)
    if score.max() > 0:
        best = int(score.argmax())
    else:
        best = next((i for i, t in enumerate(tag) if t in ("article", "main", "body")), 0)
    holds, up = [False] * n, best
    while up >= 0:
        holds[up] = True
        up = parent[up]
    up = best
    while up > 0 and tag[up] not in ("article", "main"):
        up = parent[up]
    best = up if up > 0 else best
    #: Marks that end a sentence, and blocks, of each list.
    lists = {}
    owner = [0] * n
    for node in range(1, n):
        owner[node] = node if tag[node] in ("ul", "ol") else owner[parent[node]]
    for node, text, _ in blocks:
        if owner[node]:
            held = lists.setdefault(owner[node], [0, 0])
            held[0] += any(c in text for c in (". ", "; ", ": ")) or text[-1] in ".!?。"
            held[1] += 1
    inner = tag[parent[best]] not in ("body", "html", "#")
    #: Below the kept: 1; what was met on the way: 2 a header, 4 a list of links, 8 a part of links.
    state = [0] * n
    for node in range(n):
        density = linked[node] / chars[node] if chars[node] else 0.0
        keeps = node == best
        if node != best and best and parent[node] == parent[best] and chars[node]:
            reads_on = tag[node] in READS_ON and density < 0.25
            keeps = score[node] >= max(0.2 * score[best], 2) or reads_on or (inner and density < 0.5) or (tag[node] in ("h1", "h2") and node < best)
        if keeps:
            state[node] = 1
        elif node and state[parent[node]]:
            met = state[parent[node]]
            met |= 2 if tag[node] == "header" else 0
            met |= 4 if _link_list(page, node, lists.get(node, [0, 0]), chars, linked) else 0
            met |= 8 if tag[node] in ("div", "section") and not holds[node] and density > 0.66 and node not in lists else 0
            state[node] = met
    return [text for node, text, _ in blocks if state[node] & 1 and not state[node] & 12 and (not state[node] & 2 or tag[node] in HEADINGS)]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(Page(html))) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    Null and empty html, and pages without text, give an empty text. Repeated rows each get a row;
    other columns are not carried. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    texts = F.pandas_udf(lambda s: pd.Series([main_text(h) for h in s], dtype=object), "string")
    out = rows.select("page_id", "url", texts("html").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
