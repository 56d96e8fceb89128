"""Operator 9: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides each
block by length, stop-word density and link density, wherever it stands; out
are also regions whose tag or role says that they are not the article
(navigation, forms, ...) and those whose class or id does (adverts, comments,
...).  A class or id does not count on an element that holds ``main`` or more
than half of the page's prose (long blocks of many stop words and few links):
that is a wrapper ('has-sidebar').  In
a marked article few stop words alone decide only long blocks, at half the
density, if the rest is prose by more than half.  The second pass gives the
blocks that stayed open, mostly short ones, the label of the nearest decided block of the
same article; if there is none, those of a marked article (``article``,
``main``) stay and others go.  On pages that mark an article, open blocks
outside go.

Stop words are fixed ones of four languages and, by the language a page
declares, the words that stand in a quarter of all pages' prose-length blocks.

White space in a block becomes one blank, character references are decoded,
kept blocks are joined in page order by a line feed.

Defined results: null or empty html, and a page without kept blocks, give an
empty text; unclosed and misnested tags are read as far as they go; pages are
read whole, and alone but for the stop words; ties cannot matter; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import written

SHORT, LONG = 60, 160                    # characters
LINKED = 0.5                             # share of a block's characters inside links
STOP_LOW, STOP_HIGH = 0.1, 0.2           # share of a block's words that are stop words
COMMON, LEAST_BLOCKS = 0.25, 20          # a stop word stands in this share of a language's long blocks, if it has so many
COUNTED_WORDS = 100_000                  # distinct words a task counts before it sends them on

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the
their them there they this to was we were which who will with you
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour
qu que qui sa se ses son sur un une vous
als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist
mit nach nicht noch nur oder sein sich sie sind um und von vor war wie wir zu zum zur
al como con cuando del donde el ella entre era es esta este fue ha hay las lo los más me mi muy no nos o para pero
por se si sin sobre son su sus también una uno y ya
""".split())

# Tags by their role in a page.
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
title tr ul
""".split())
DROP_TAGS = frozenset("""
aside audio button canvas datalist dialog footer form head iframe input label map math menu nav noscript object
option script select style svg template textarea title video
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT_OPEN = (BLOCK_TAGS | DROP_TAGS) - VOID_TAGS - {"p"}
ARTICLE_TAGS = frozenset(["article", "main"])

# Words by which classes, ids and roles name regions that are not the article.
DROP_WORDS = frozenset("""
ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline comment comments
complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer form gdpr login masthead
menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion promotions related
replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets
""".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+").findall
_WORDS = re.compile(r"\w+").findall
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    article: int                          # which marked article it stands in, 0 outside any
    dropped: bool
    named: int                            # the innermost element around it whose class or id names a region, -1 if none
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None             # True: main text, False: not, None: open


def _drops(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true")
               or (name == "role" and value and not DROP_WORDS.isdisjoint(value.lower().split())) for name, value in attrs)


def _names_drop(attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    for name, value in attrs:
        if name in ("class", "id") and value:
            words = {w.lower() for w in _PARTS(value)}
            if words & DROP_WORDS or ("header" in words and not in_article):
                return True
    return False


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []     # tag, dropped, article, named
        self.around: list[int] = []                          # of each named element, the named one around it
        self.wraps: list[bool] = []                          # and whether it holds main
        self.language = ""
        self.articles = 0
        self.links = 0
        self.blocks: list[Block] = []
        self.fresh()

    def top(self) -> tuple[str, bool, int, int]:
        return self.open[-1] if self.open else ("", False, 0, -1)

    def name(self, around: int) -> int:
        self.around.append(around)
        self.wraps.append(False)
        return len(self.around) - 1

    def fresh(self) -> None:
        _, dropped, article, named = self.top()
        self.block = Block(article, dropped, named)
        self.blocks.append(self.block)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html" and not self.language:
            self.language = (dict(attrs).get("lang") or "").lower().replace("_", "-").split("-")[0][:3]
        if tag in KEPT_OPEN:
            _, dropped, article, named = self.top()
            if tag == "main" and named >= 0:
                self.wraps[named] = True
            if tag in ARTICLE_TAGS and not article and not dropped:
                self.articles += 1
                article = self.articles
            drop = tag in DROP_TAGS or (tag == "header" and not article) or _drops(attrs)
            if tag not in ("html", "body") and _names_drop(attrs, bool(article)):
                named = self.name(named)
            self.open.append((tag, dropped or drop, article, named))
        elif tag == "a":
            self.links = 1
        elif tag == "br":
            self.block.parts.append(" ")
        if tag in BLOCK_TAGS or tag in DROP_TAGS:
            self.links = 0
            self.fresh()
            if tag == "p":
                self.block.dropped |= _drops(attrs)
                if _names_drop(attrs, bool(self.block.article)):
                    self.block.named = self.name(self.block.named)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID_TAGS or tag not in KEPT_OPEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        elif tag in KEPT_OPEN:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break
        if tag in BLOCK_TAGS or tag in DROP_TAGS:
            self.fresh()

    def handle_data(self, data: str) -> None:
        self.block.parts.append(data)
        if self.links:
            self.block.linked += len(data)


def _density(block: Block, stop_words: frozenset[str]) -> float:
    words = _WORDS(block.text.lower())
    return sum(w in stop_words for w in words) / max(1, len(words))


def _decide(block: Block, stop_words: frozenset[str]) -> bool | None:
    """First pass: the block by itself."""
    if block.dropped or block.linked > LINKED * len(block.text):
        return False
    if len(block.text) < SHORT:
        return None
    density = _density(block, stop_words)
    if density >= STOP_HIGH:
        return True if len(block.text) >= LONG or block.article else None
    return None if density >= STOP_LOW or block.article else False


def _drop_unlike(blocks: list[Block], stop_words: frozenset[str]) -> None:
    """In an article that is prose by more than half, long blocks of hardly any stop words are out."""
    size, prose = Counter(), Counter()
    for b in blocks:
        if b.article and not b.dropped:
            size[b.article] += len(b.text)
            prose[b.article] += len(b.text) if b.label else 0
    for b in blocks:
        if b.article and b.label is None and len(b.text) >= LONG and 2 * prose[b.article] > size[b.article]:
            b.label = False if _density(b, stop_words) < STOP_LOW / 2 else None


def _drop_named(page: _Page, blocks: list[Block]) -> None:
    """Blocks of named regions are out, but for those of named elements that are wrappers."""
    prose = [0] * len(page.around)
    total = 0
    for b in blocks:
        if b.label and len(b.text) >= LONG:
            total += len(b.text)
            if b.named >= 0:
                prose[b.named] += len(b.text)
    out = page.wraps[:]
    for i in range(len(prose) - 1, -1, -1):                # an element's number is above that of those around it
        if page.around[i] >= 0:
            prose[page.around[i]] += prose[i]
            out[page.around[i]] |= out[i]
    for i, held in enumerate(prose):
        out[i] = (2 * held <= total and not out[i]) or (page.around[i] >= 0 and out[page.around[i]])
    for b in blocks:
        if b.named >= 0 and out[b.named]:
            b.dropped, b.label = True, False


def _inherit(blocks: list[Block]) -> None:
    """Second pass: open blocks take the label of the nearest decided block of
    their article or page; at equal distance being main text wins."""
    groups: dict[int, list[Block]] = {}
    for b in blocks:
        groups.setdefault(b.article, []).append(b)
    for article, group in groups.items():
        n = len(group)
        best: list[tuple[int, bool] | None] = [None] * n
        for order in (range(n), range(n - 1, -1, -1)):
            seen: tuple[int, bool] | None = None
            for i in order:
                # what an article leaves out (a link list, say) says nothing about the text beside it
                if group[i].label is not None and (group[i].label or not article):
                    seen = (0, group[i].label)
                elif seen is not None:
                    seen = (seen[0] + 1, seen[1])
                    if best[i] is None or seen[0] < best[i][0] or (seen[0] == best[i][0] and seen[1]):
                        best[i] = seen
        for b, near in zip(group, best):
            if b.label is None:
                b.label = near[1] if near else bool(article)


def _read(html: str) -> tuple[_Page, list[Block]]:
    """The page and its blocks that have text."""
    page = _Page()
    page.feed(html)
    page.close()
    blocks = []
    for b in page.blocks:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
        if b.text:
            blocks.append(b)
    return page, blocks


def extract(html: str | None, more_stop_words: dict[str, frozenset[str]] | None = None) -> list[str]:
    """The kept blocks of one page; ``more_stop_words`` by language."""
    if not html:
        return []
    page, blocks = _read(html)
    stop_words = STOP_WORDS | (more_stop_words or {}).get(page.language, frozenset())
    for b in blocks:
        b.label = _decide(b, stop_words)
    _drop_named(page, blocks)
    _drop_unlike(blocks, stop_words)
    if any(b.article and not b.dropped for b in blocks):
        for b in blocks:
            if b.label is None and not b.article:
                b.label = False
    _inherit(blocks)
    return [b.text for b in blocks if b.label]


def common_words(pages: DataFrame, html_col: str = "html") -> dict[str, frozenset[str]]:
    """Of every declared language, the words that stand in a quarter of its
    long blocks with few links; a block repeated on many pages counts each time."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in found.items()], columns=["language", "word", "n"])

        for batch in batches:
            for html in batch["html"]:
                page, blocks = _read(html or "")
                for b in blocks:
                    if not b.dropped and len(b.text) >= LONG and b.linked <= LINKED * len(b.text):
                        found.update((page.language, w) for w in {"", *_WORDS(b.text.lower())})     # "" counts blocks
                if len(found) > COUNTED_WORDS:             # bounded: Spark adds up the rest
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    counts = written(pages.select(F.col(html_col).alias("html")).mapInPandas(count, "language string, word string, n long")
                     .groupBy("language", "word").agg(F.sum("n").alias("n")), "html-words")
    blocks = counts.filter("word = ''").select("language", F.col("n").alias("blocks")).filter(F.col("blocks") >= LEAST_BLOCKS)
    out: dict[str, set[str]] = {}
    for r in counts.filter("word <> ''").join(blocks, "language").filter(F.col("n") >= COMMON * F.col("blocks")).collect():
        out.setdefault(r["language"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in out.items()}


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    stop_words = common_words(pages, html_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["page_id", "url"]].assign(text=["\n".join(extract(h, stop_words)) for h in batch["html"]])

    return slim.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
