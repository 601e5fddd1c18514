"""Main text of web pages by two passes of block rules.

A page is cut into blocks of text. What is in menus, footers, notices, adverts, forms and readers' comments, by its
elements and their class words, reads like text and is none: it is taken out before. The first pass decides each
other block by its link density, its length and the density of stop words: link lists are no text, and long blocks with
enough stop words are. Other blocks are ambiguous, the short ones above all. The second pass lets each of them take
the label of the nearest decided block of its own section. Where its section has none, and densities found text in
the page's article, a block in that is text and one outside of it is none; else it takes the label of the nearest
decided block of all. Where the first pass finds no text at all, as in languages whose stop words are not listed and
on pages of short lines, length and link density decide alone: the long blocks are text, or, without any, all that
are no link lists, those of an article where there is one.
A form that holds most of a page's text, as one around a whole page does, is no form in this sense.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import name

#: Elements whose content is no text at all, up to their end tag.
RAW = frozenset("script style noscript template iframe object svg canvas math audio video textarea select title".split())
#: Where each ends; only ASCII letters have another case here, so no lower-cased copy of a page is needed.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article's text.
BOILERPLATE = frozenset("nav footer aside menu dialog button fieldset head".split())
#: Words of a class, id or role that mark such parts.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disclaimer disqus dialog footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary".split()
)
#: Words that outweigh them.
CONTENT = frozenset("article articlebody body content entry main post story text title".split())
STOP_WORDS = frozenset(
    # Common words of English, French, German and Spanish.
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their this to was were what when which who will with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "als auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht sich sie sind so und von war wie zu zum zur über "
    "al como con de del el ella en entre es esta la las le lo los más no o para pero por que se sin sobre su sus también un una y".split()
)
#: Share of stop words from which on a long block is text, characters of a long block, share of linked ones of a list.
STOP_DENSITY = 0.15
LONG = 140
LINK_DENSITY = 0.5

TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
SPECIAL = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    links: int
    boilerplate: bool
    inside: bool
    section: int
    forms: tuple[int, ...] = ()


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, int, int]] = field(default_factory=list)
    open: dict[str, int] = field(default_factory=dict)
    boilerplate: int = 0
    inside: int = 0
    links: int = 0
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    sections: list[int] = field(default_factory=lambda: [0])
    made: int = 0
    forms: list[int] = field(default_factory=list)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                links = sum(len(" ".join(html.unescape(x).split())) for x in self.linked)
                self.blocks.append(Block(text, links, self.boilerplate > 0, self.inside > 0, self.sections[-1], tuple(self.forms)))
            self.parts, self.linked = [], []

    def push(self, tag: str, attributes: str) -> None:
        bad, good = int(tag in BOILERPLATE), int(tag in ("article", "main"))
        if not good and tag not in ("html", "body") and attributes:
            hints = {w.lower() for m in ATTRIBUTE.finditer(attributes) for w in HINT.findall(m[2] or m[3] or m[4] or "")}
            if hints & MARKS and not hints & CONTENT:
                bad = 1
            elif "main" in hints and not hints & MARKS:
                good = 1
        if tag == "header" and not self.inside:
            bad = 1
        if self.inside and good:
            # An article within another one, as readers' comments are, is part of it only without marks.
            good = 0
        self.stack.append((tag, bad, good))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.boilerplate += bad
        self.inside += good
        self.links += tag == "a"
        if bad or good or tag in ("section", "form"):
            self.made += 1
            if tag == "form":
                self.forms.append(self.made)
            self.sections.append(self.made)
        else:
            self.sections.append(self.sections[-1])

    def pop(self, tag: str) -> None:
        while self.open.get(tag):
            last, bad, good = self.stack.pop()
            self.sections.pop()
            self.open[last] -= 1
            self.boilerplate -= bad
            self.inside -= good
            self.links -= last == "a"
            if last == "form":
                self.forms.pop()
            if last == tag:
                return


class _Tags:
    """The tags of a page from left to right, in time linear in the page, however broken it is."""

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.quotes = True

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, closing) of the next tag from ``at`` on; comments and the like have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), start):
                mark = "-->" if page.startswith("<!--", start) else ">"
                end = page.find(mark, start + 2)
                return start, len(page) if end < 0 else end + len(mark), "", "", False
            if start > self.last_end:
                return None
            m = TAG_NAME.match(page, start + 1)
            if m:
                end = self._end(m.end())
                return start, end + 1, m[1].lower(), page[m.end() : end], page[start + 1] == "/"
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Where the tag ends: at the first > outside of quotes, or at the first one where the quotes never end.

        A page whose quotes leave no > to its end is read without them from there on.
        """
        first = self.page.find(">", at)
        while self.quotes:
            m = SPECIAL.search(self.page, at)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            elif m.start() >= self.last_quote[m[0]]:
                break
            else:
                at = self.page.index(m[0], m.end()) + 1
        return first


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    s, at, size, tags = _State(), 0, len(page), _Tags(page)
    while at < size:
        found = tags.next(at)
        text = page[at : found[0]] if found else page[at:]
        if text:
            s.parts.append(text)
            if s.links:
                s.linked.append(text)
        if not found:
            break
        _, at, tag, attributes, closing = found
        if not tag:
            continue
        if tag == "br":
            s.parts.append(" ")
        elif tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else size
            continue
        if tag in BLOCK:
            s.flush()
        if closing:
            s.pop(tag)
        elif tag not in VOID:
            if tag in BLOCK and s.open.get("p"):
                s.pop("p")
            if tag in ("li", "option") and s.stack and s.stack[-1][0] == tag:
                s.pop(tag)
            s.push(tag, attributes)
    s.flush()
    return s.blocks


def stop_density(text: str) -> float:
    """Share of the words that are stop words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _linked(block: Block) -> bool:
    return block.links > LINK_DENSITY * len(block.text)


def without_boilerplate(blocks: list[Block]) -> list[Block]:
    """The blocks that elements and class words leave: not in marked parts, nor in a form that holds less than half of their text."""
    rest = [b for b in blocks if not b.boilerplate]
    size = lambda b: 0 if _linked(b) else len(b.text)
    held: dict[int, int] = {}
    for b in rest:
        for f in b.forms:
            held[f] = held.get(f, 0) + size(b)
    most = sum(map(size, rest)) / 2
    return [b for b in rest if all(held[f] > most for f in b.forms)]


def decide(block: Block) -> bool | None:
    """First pass: whether a block is text; None for an ambiguous one."""
    if _linked(block):
        return False
    if len(block.text) >= LONG and stop_density(block.text) >= STOP_DENSITY:
        return True
    return None


def main_text(page: str | None) -> str:
    """The text blocks of a page joined by blank lines; '' for none."""
    blocks = without_boilerplate(blocks_of(page or ""))
    labels = [decide(b) for b in blocks]
    if True not in labels:
        labels = _by_length(blocks, labels)
    marked = any(b.inside and label for b, label in zip(blocks, labels, strict=True))
    # Second pass: the nearest decided block before and after, of the same section first.
    before, after = _nearest(blocks, labels, 1), _nearest(blocks, labels, -1)
    kept = []
    for i, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            near = [x for x in (before[i], after[i]) if x is not None]
            own = [x for x in near if x[0] == b.section]
            if not own and marked:
                label = b.inside
            elif near:
                label = labels[min(own or near, key=lambda x: (abs(x[1] - i), not labels[x[1]]))[1]]
        if label:
            kept.append(b.text)
    return "\n\n".join(kept)


def _by_length(blocks: list[Block], labels: list[bool | None]) -> list[bool | None]:
    """The labels of a page on which stop words find no text: long blocks are text, or else all with a word that no list of links is."""
    labels = [False if label is None and not WORD.search(b.text) else label for b, label in zip(blocks, labels, strict=True)]
    inside = any(b.inside and label is None for b, label in zip(blocks, labels, strict=True))
    long = [label is None and len(b.text) >= LONG and (b.inside or not inside) for b, label in zip(blocks, labels, strict=True)]
    if any(long):
        return [True if x else label for x, label in zip(long, labels, strict=True)]
    return [(b.inside or not inside) if label is None else label for b, label in zip(blocks, labels, strict=True)]


def _nearest(blocks: list[Block], labels: list[bool | None], step: int) -> list[tuple[int, int] | None]:
    """For each block the section and index of the last decided one on the way, of its own section if that has one."""
    out: list[tuple[int, int] | None] = [None] * len(blocks)
    last, own = None, {}
    for i in range(len(blocks))[::step]:
        out[i] = own.get(blocks[i].section, last)
        if labels[i] is not None:
            last = own[blocks[i].section] = (blocks[i].section, i)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (its code points).

    A null or empty page has the text ''. Pages are parsed whole, in time linear in their length; unclosed
    elements end with those around them, and what never closes ends with the page. Repeated rows and rows with
    one page_id each have a row. Other columns, whatever their names, are not read. An empty table gives an
    empty result.
    """
    slim = pages.select(name("page_id").alias("page_id"), name("url").alias("url"), name("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
