"""Main text of web pages by minimum-cut labelling.

A page is read once into blocks (stretches of text between block-level tags), each with the signs a classifier
looks at: length, share of link text, punctuation, and whether it stands in an article or in something that is
hardly ever main text. An element that is marked so by its name or kind, but holds the page's article or nearly all of its
words, is a wrapper, and its mark counts for nothing (comments and what is hidden stay marked). The classifier's costs become capacities from the source (content) or to the sink (boilerplate);
neighbouring blocks and blocks of one parent are tied by smoothness edges. The minimum cut is the labelling of
least cost; the text is the content blocks in page order.

Pages are independent rows of one narrow pass; nothing is shuffled. A page is read in time linear in its length,
whatever its tags: no pattern goes back, and an end tag looks for its element only where one is open.

Nulls: a null html is an empty page with an empty text. Rows of equal or null page_id are each returned. An
empty table gives no rows. Unclosed tags and a missing end of the page are read as browsers do, roughly. Extra
columns are not used, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches

#: A tag's beginning and name; its attributes, quoted values whole. Neither ever goes back, so a page is read in linear time.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Decimal references beyond any character, and zeros before one.
HUGE, ZEROS = re.compile(r"&#0*+[1-9][0-9]{7,}+;?"), re.compile(r"&#0++(?=[0-9])")
SIGN = re.compile("[.!?;:,。]")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup mover munder munderover mfenced semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select option canvas audio video annotation annotation-xml".split())
NEVER = frozenset("nav footer aside form button menu dialog fieldset head".split())
MAIN = frozenset("article main".split())
#: Open elements that the beginning of another one ends, besides an open paragraph.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
#: Tags whose names say nothing about what they hold: the whole page, and headings named after their topic.
NAMELESS = frozenset("html body h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that mark what is never main text; the second set only outside an article.
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer cookie cookies consent gdpr notice popup modal newsletter subscribe subscription share sharing social related comment comments disqus replies"
    " widget toolbar pagination pager login signup register search complementary contentinfo skip".split()
)
OUTER_NAMES = frozenset("header masthead topbar top".split())
#: Names of what readers write: never a wrapper, however long. Elements that are wrappers only around an article.
READERS = frozenset("comment comments disqus replies".split())
NO_WRAPPER = frozenset("nav footer aside menu dialog head".split())
#: A wrapper holds this share of the page's words at least, and half of them in an article; or this share and so many words.
HOLDS, NEARLY_ALL, ENOUGH = 0.5, 0.8, 80
#: Lines of rights that stand in no marked element: a sign and a year at the beginning, or a set phrase, in a short block.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|copr\.)[^.]{0,60}\b(?:19|20)\d\d\b|.{0,200}\b(?:all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados)\b", re.I | re.S)
RIGHTS_WORDS = 40
#: Costs, in hundredths: the classifier's weights and the smoothness of neighbours and of siblings. They are set by
#: hand, as no page is labelled. A name weighs less than an element that is never main text.
BIAS, PER_LOG_WORD, PER_LINK_SHARE, PUNCTUATION, IN_MAIN, IN_NEVER, NAMED, NEIGHBOUR, SIBLING, LEGAL = -80, 120, -400, 100, 300, -2500, -1500, 60, 80, -900


@dataclass
class Mark:
    """An element that is hardly ever main text: what that costs its blocks, the mark around it, and whether it can be a wrapper."""

    cost: int
    around: int
    wraps: bool  # around an article
    wraps_all: bool  # around nearly everything
    words: int = 0
    in_main: int = 0


@dataclass
class Block:
    parent: int
    mark: int
    main: bool
    parts: list[str] = field(default_factory=list)
    link: int = 0
    text: str = ""
    never: int = 0
    words: int = 0

    def cost(self) -> int:
        """Above zero: what calling it boilerplate costs; below: what calling it content costs."""
        share = min(1.0, self.link / max(1, len(self.text)))
        legal = LEGAL * (not self.main and self.words <= RIGHTS_WORDS and RIGHTS.match(self.text) is not None)
        return round(BIAS + PER_LOG_WORD * log1p(self.words) + PER_LINK_SHARE * share + PUNCTUATION * bool(SIGN.search(self.text)) + IN_MAIN * self.main + self.never + legal) or -1


@dataclass
class Element:
    """An open block-level element: its mark, and the inline elements (tag, mark) open in it. Mark 0 is none."""

    tag: str
    mark: int
    main: bool
    number: int
    inline: list[tuple[str, int]] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)

    @property
    def now(self) -> int:
        return self.inline[-1][1] if self.inline else self.mark


def weigh(blocks: list[Block], marks: list[Mark]) -> None:
    """Set what the marks around each block cost, without those of wrappers."""
    for b in blocks:
        b.words = len(b.text.split())
        marks[b.mark].words += b.words
        marks[b.mark].in_main += b.words * b.main
    for m in reversed(marks[1:]):  # marks inside come after those around them
        marks[m.around].words += m.words
        marks[m.around].in_main += m.in_main
    total, cost = max(1, marks[0].words), [0] * len(marks)
    for k, m in enumerate(marks[1:], 1):
        article = m.wraps and m.words >= HOLDS * total and 2 * m.in_main >= m.words
        nearly = m.wraps_all and m.words >= max(ENOUGH, NEARLY_ALL * total)
        cost[k] = min(cost[m.around], 0 if article or nearly else m.cost)
    for b in blocks:
        b.never = cost[b.mark]


def signs(attributes: str) -> tuple[set[str], bool]:
    """Names in class, id and role, each a whole one, or all parts of a hyphenated one of which every part marks what is
    never main text; and whether the element is hidden."""
    names, hidden = set(), False
    for x in ATTRIBUTE.finditer(attributes):
        key, value = x[1].lower(), (x[2] or x[3] or x[4] or "").lower()
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = set(re.split("[-_]+", name))
                names |= parts if parts <= NEVER_NAMES else {name}
        hidden = hidden or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and bool(NO_DISPLAY.search(value)))
    return names, hidden


def plain(parts: list[str]) -> str:
    """Decoded, white space as single spaces."""
    text = "".join(parts)
    if "&#" in text:
        text = ZEROS.sub("&#", HUGE.sub("\ufffd", text))
    return " ".join(entities.unescape(text).split())


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    stack, open_blocks, marks = [Element("", 0, False, 0)], Counter(), [Mark(0, 0, False, False)]
    links, number, pos, now, held = 0, 0, 0, None, None  # held: the block that an inline notice or advert interrupts
    quotes, endless = True, set()  # whether quotes are still trusted; raw elements that end nowhere further on

    def close_block():
        nonlocal now, held
        for b in (now, held):
            if b is not None:
                b.text = plain(b.parts)
        now = held = None

    def add(text: str):
        nonlocal now
        if now is None:
            if not text.strip():
                return
            now = Block(stack[-1].number, stack[-1].now, stack[-1].main)
            out.append(now)
        now.parts.append(text)
        now.link += len(text) * (links > 0)

    def leave():
        """The last block-level element ends."""
        nonlocal links
        links -= stack[-1].open["a"]
        open_blocks[stack.pop().tag] -= 1

    def leave_inline(tag: str):
        """An inline element of the last block-level one ends, and with it those inside."""
        nonlocal links, now, held
        e, mark = stack[-1], stack[-1].now
        while e.open[tag]:
            last, _ = e.inline.pop()
            e.open[last] -= 1
            links -= last == "a"
            if last == tag:
                break
        if mark != e.now:  # what follows an inline notice goes on with the block before it
            if now is not None:
                now.text, now = plain(now.parts), None
            if held is not None and held.mark == e.now:
                now, held = held, None
                now.parts.append(" ")

    while pos < len(page):
        at = page.find("<", pos)
        if at != pos:
            add(page[pos:at] if at > 0 else page[pos:])
            if at < 0:
                break
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            pos = at + 5 if page.startswith(">", at + 4) else stop + 3 if stop >= 0 else len(page)
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            pos = page.find(">", at) + 1 or len(page)
            continue
        m = TAG.match(page, at)
        if m is None:
            add("<")
            pos = at + 1
            continue
        stop = INSIDE.match(page, m.end()).end() if quotes else -1
        if not page.startswith(">", stop) or stop < 0:
            quotes, stop = False, page.find(">", m.end())
            if stop < 0:  # the page ends inside a tag
                break
        pos, end, tag, attributes = stop + 1, bool(m[1]), m[2].lower(), page[m.end() : stop]
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in RAW and not end:
            if not attributes.rstrip().endswith("/"):
                found = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, pos)
                if found:
                    pos = found.end()
                else:
                    endless.add(tag)
                    pos = len(page) if tag in ("script", "style", "title", "textarea") else pos
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in INLINE:
            if end:
                leave_inline(tag)
                continue
        elif tag in VOID:
            if tag == "hr":
                close_block()
            continue
        else:
            close_block()
            if end:
                while open_blocks[tag]:
                    last = stack[-1].tag
                    leave()
                    if last == tag:
                        break
                continue
            while stack[-1].tag == "p" or stack[-1].tag in ENDS.get(tag, ()):
                leave()
        e = stack[-1]
        main = e.main or tag in MAIN
        names, hidden = signs(attributes) if attributes and not attributes.isspace() else (set(), False)
        if tag in NAMELESS:
            names = set()
        mark = e.now
        if hidden or tag in NEVER or names & NEVER_NAMES or (not main and (tag == "header" or names & OUTER_NAMES)):
            loose = not hidden and not names & READERS
            marks.append(Mark(IN_NEVER if hidden or tag in NEVER else NAMED, mark, loose, loose and tag not in NO_WRAPPER))
            mark = len(marks) - 1
        elif "main" in names and marks[mark].cost == 0:
            main = True
        links += tag == "a"
        if tag in INLINE:
            if now is not None and mark != e.now:
                if held is None:
                    held, now = now, None  # an inline notice or advert is a block of its own
                else:
                    now.text, now = plain(now.parts), None
            e.inline.append((tag, mark))
            e.open[tag] += 1
        else:
            number += 1
            open_blocks[tag] += 1
            stack.append(Element(tag, mark, main, number))
    close_block()
    out = [b for b in out if b.text]
    weigh(out, marks)
    return out


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source's side. costs above 0 are capacities from the source, below 0 to the sink;
    edges (i, j, capacity) go both ways. Shortest augmenting paths over level graphs."""
    n = len(costs)
    s, t = n, n + 1
    to, cap, at = [], [], [[] for _ in range(n + 2)]

    def edge(a, b, c, back):
        at[a].append(len(to))
        to.append(b)
        cap.append(c)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            edge(s, i, c, 0)
        elif c < 0:
            edge(i, t, -c, 0)
    for i, j, c in edges:
        edge(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
            elif nxt[a] < len(at[a]):
                e = at[a][nxt[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    nxt[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return " ".join(b.text for b, content in zip(blocks, min_cut([b.cost() for b in blocks], edges)) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(work, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
