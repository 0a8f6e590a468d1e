"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides a block
by the density of stop words in it, its length and the share of its text in
links: long running text is good, text full of links or with hardly a stop word
is bad, short blocks and those between are undecided.  The place of a block is
one more feature: what stands in navigation, forms, footers, comments and the
like is bad, and less density is asked for inside an article.  The second pass
gives each undecided block the label of its nearest decided neighbours.  Where
the two sides disagree, a heading goes with what follows it, a block of middle
length with many stop words is good, one inside an article is good, and any
other is bad.

Reading a page takes time in proportion to its length: one position moves
forward, and open elements are counted by name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Frequent function words of the languages that the rules know.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you
    aber als am an auch auf aus bei das dem den der des die ein eine einer es für hat ich im in ist mit nicht noch oder sich sie sind um und von war werden wie wird zu zum zur
    à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con de del el ella en entre era es esta este fue ha hay la las lo los más mi muy no o para pero por que se ser si sin su sus también un una y ya""".split()
)

# Elements by what they do to the text around them.
BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED_TAGS = frozenset("script style noscript template textarea title svg math iframe object canvas audio video xmp noembed noframes".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset option search head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer masthead modal nav navbar navigation newsletter pagination pager popup promo promoted replies sidebar sponsored subscribe".split())
# Words that ordinary class names have too: they count unless the block is running text of an article.
WEAK_WORDS = frozenset("banner header menu notice related reply respond share sharing social sponsor toolbar widget".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
MARK = re.compile(r"[>\"']")
WORD = re.compile(r"\w+")
ENDS = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.IGNORECASE) for t in SKIPPED_TAGS}

SHORT = 70  # code points
LONG = 200
STOPS_LOW, STOPS_HIGH = 0.10, 0.25
LINKS = 0.5

GOOD, BAD, OPEN, NEAR = 1, 0, -1, -2

#: text, code points in links, how its place speaks against it (2: surely, 1: perhaps), stands in an article, is a heading
Block = tuple[str, int, int, bool, bool]


def bad_by_attributes(attributes: str) -> int:
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return 2
        if name == "role" and value in BAD_ROLES:
            return 2
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            if words & BAD_WORDS:
                return 2
            found = max(found, int(bool(words & WEAK_WORDS)))
    return found


class Scanner:
    """Markup of a page, one piece after the other; what was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.at, self.gone = page, 0, {}

    def find(self, what: str, at: int) -> int:
        """The next place of ``what``, or -1."""
        if at >= self.gone.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def past(self, what: str, at: int) -> int:
        """Behind the next ``what``, or the end of the page."""
        found = self.find(what, at)
        return found + len(what) if found >= 0 else len(self.page)

    def tag_end(self, at: int) -> int:
        """Where a tag ends, whose attributes begin here: at a mark outside quotes; a quote that nothing closes is none."""
        page, start = self.page, at
        while m := MARK.search(page, at):
            if m[0] == ">":
                return m.start()
            # A quote that does not open a value is an ordinary character.
            if not page[start : m.start()].rstrip().endswith("=") if m.start() - start < 4096 else page[m.start() - 1] != "=":
                at = m.end()
                continue
            close = self.find(m[0], m.end())
            if close < 0:
                return self.past(">", start) - 1 if self.find(">", start) >= 0 else len(page)
            at = close + 1
        return len(page)

    def pieces(self) -> Iterator[tuple[str, str, str, bool]]:
        """(text before, name of the tag or empty, its attributes, whether it closes), in order."""
        page = self.page
        while True:
            at = self.at
            lt = page.find("<", at)
            while lt >= 0 and not (page[lt + 1 : lt + 2] in ("!", "?") or NAME.match(page, lt + 1 + (page[lt + 1 : lt + 2] == "/"))):
                lt = page.find("<", lt + 1)
            if lt < 0:
                self.at = len(page)
                yield page[at:], "", "", False
                return
            before = page[at:lt]
            if page.startswith("<!--", lt):
                self.at = self.past("-->", lt + 4)
                yield before, "", "", False
            elif page.startswith("<![CDATA[", lt):
                self.at = self.past("]]>", lt + 9)
                yield before + page[lt + 9 : self.at].removesuffix("]]>"), "", "", False
            elif page[lt + 1] in "!?":
                self.at = self.past(">", lt)
                yield before, "", "", False
            else:
                closing = page[lt + 1] == "/"
                name = NAME.match(page, lt + 1 + closing)
                end = self.tag_end(name.end())
                self.at = min(end + 1, len(page))
                yield before, name[0].lower(), page[name.end() : end], closing


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements, and how each speaks against what is in it
    opened: Counter[str] = Counter()
    against: Counter[int] = Counter()
    parts: list[str] = []
    in_links: list[str] = []

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(in_links)).split()))
            article = opened["article"] + opened["main"] > 0
            out.append((text, linked, 2 if against[2] else 1 if against[1] else 0, article, bool(stack) and stack[-1][0] in HEADINGS))
        parts.clear()
        in_links.clear()

    def pop() -> str:
        name, bad = stack.pop()
        opened[name] -= 1
        against[bad] -= 1
        return name

    scanner = Scanner(page)
    for before, tag, attributes, closing in scanner.pieces():
        parts.append(before)
        if opened["a"]:
            in_links.append(before)
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            close_block()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in SKIPPED_TAGS:
            if not attributes.endswith("/"):
                end = ENDS[tag].search(page, scanner.at)
                scanner.at = end.end() if end else len(page)
            continue
        if tag in VOID_TAGS:
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:
            pop()
        if tag == "body":  # an unclosed head ends here
            while stack:
                pop()
        inside = opened["article"] + opened["main"] > 0
        bad = 2 if tag in BAD_TAGS and not (tag == "header" and inside) else 0
        if tag not in ("html", "body", "article", "main"):
            bad = max(bad, bad_by_attributes(attributes))
        stack.append((tag, bad))
        opened[tag] += 1
        against[bad] += 1
    close_block()
    return out


def first_pass(block: Block) -> int:
    text, linked, bad, article, _ = block
    if bad == 2 or linked > LINKS * len(text):
        return BAD
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if bad == 1 and not (article and len(text) > LONG and stops >= STOPS_LOW):
        return BAD
    if len(text) < SHORT:
        return OPEN
    if article:
        return GOOD if stops >= STOPS_LOW else OPEN
    if stops >= STOPS_HIGH:
        return GOOD if len(text) > LONG else NEAR
    return OPEN if stops >= STOPS_LOW else BAD


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    def nearest(order: Iterable[int]) -> dict[int, int]:
        seen, last = {}, BAD
        for i in order:
            seen[i] = last
            last = labels[i] if labels[i] in (GOOD, BAD) else last
        return seen

    before, after = nearest(range(len(blocks))), nearest(reversed(range(len(blocks))))
    out = []
    for i, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if label in (OPEN, NEAR):
            sides = {before[i], after[i]}
            mixed = GOOD in sides and (block[4] and after[i] == GOOD or label == NEAR or block[3])
            label = GOOD if sides == {GOOD} or mixed else BAD
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by an empty line; empty for an empty or missing page.

    Where a page marks its article, what stands outside is bad; where no block
    of the article can be decided, as they are all short, its undecided ones are
    the text.
    """
    if not page:
        return ""
    blocks = blocks_of(page)
    if any(b[3] and b[2] < 2 for b in blocks):
        blocks = [(t, n, bad if article else 2, article, h) for t, n, bad, article, h in blocks]
    first = [first_pass(b) for b in blocks]
    if GOOD not in first:
        first = [GOOD if b[3] and label in (OPEN, NEAR) else label for b, label in zip(blocks, first, strict=True)]
    labels = second_pass(blocks, first)
    return "\n\n".join(b[0] for b, label in zip(blocks, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the columns text and n_chars, which replace columns of these names.

    Every row keeps its place, repeated rows too; a null or empty page has the
    empty text.  A page is read whole, however long.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(main_text)

    own = [f"`{c}`" for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*own, text(F.col(f"`{column}`")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
