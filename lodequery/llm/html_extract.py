"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by
where it stands (``article`` and ``main`` against menus, footers, adverts, forms
and reader comments), by its share of linked text, by its length and by its
density of stop words; short or doubtful blocks stay undecided. In the second
pass these inherit the label of the nearest decided neighbours. The text of a
page is its good blocks in page order, each on a line.

Null and empty pages, and pages without a good block, give an empty text; very
long pages are read whole, one at a time; repeated rows give equal rows; an empty
table gives an empty result; a null url stays null; other columns are left out.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Thresholds of the block rules.
SHORT_CHARS, LONG_CHARS = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
LINK_MAX = 0.25
ARTICLE_LINK_MAX = 0.6

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we "
    "were which with you "
    "aber als auch auf aus bei das dem den der des die du ein eine einen er es für hat ich im ist mit nach nicht sich sie sind und von zu zum "
    "au aux avec ce dans de elle en est et il je la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sur un une vous "
    "al como con del el ella esta ha las lo los más no para pero por su sus una y".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
BAD_TAGS = frozenset("nav footer aside form menu button select dialog head".split())
GOOD_TAGS = frozenset(("article", "main"))
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe signup popup modal overlay comment comments disqus respond reply replies discussion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations widget footer header masthead toolbar login "
    "search complementary contentinfo skip".split()
)

# Of compound names such as ad-box, what may stand beside a bad name.
PLAIN_NAMES = frozenset("area bar block box bottom button buttons container form global inner items left links list right section site slot top unit wrap wrapper".split())
# Bad names of places whose items may be articles themselves.
ITEM_NAMES = frozenset("comment comments disqus respond reply replies discussion related recommended recommendations widget ad ads advert adverts promo".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


class _Block:
    __slots__ = ("parts", "linked", "bad", "named", "good", "tag", "text", "label")

    def __init__(self, tag: str, bad: bool, named: bool, good: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.tag, self.bad, self.named, self.good = tag, bad or named, named and not bad, good


def _bad_names(attrs: str) -> set[str]:
    """The bad names that are a whole class, id or role, or one with plain names beside them."""
    found: set[str] = set()
    for m in _ATTR.finditer(attrs):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            names = set(_NAME.findall(token))
            if names <= BAD_NAMES | PLAIN_NAMES:
                found |= names & BAD_NAMES
    return found


def blocks_of(page: str) -> list[_Block]:
    """The page's blocks with text, in page order, with what their place says of them."""
    out: list[_Block] = []
    # Open elements: tag, whether it makes its content bad or good, and the counts of bad names and of those with items outside it.
    stack: list[tuple[str, int, int, int, int]] = []
    bad = named = items = good = links = pos = 0
    block = _Block("body", False, False, False)

    def cut(tag: str) -> _Block:
        if block.parts:
            block.text = " ".join(html_lib.unescape("".join(block.parts)).split())
            if block.text:
                out.append(block)
        return _Block(tag, bad > 0, named > 0, good > 0)

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.linked += len("".join(text.split()))

    end_of_tags = page.rfind(">") + 1  # behind it nothing can be a tag, however many begin
    opened: Counter[str] = Counter()
    while m := _TAG.search(page, pos, end_of_tags):
        add(page[pos : m.start()])
        pos = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            pos = len(page)
            break
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW_TAGS:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            if tag == "title":
                block = cut(tag)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            add(" ")
        if tag in BLOCK_TAGS:
            links = 0
        if tag in VOID_TAGS:
            if tag == "hr":
                block = cut(tag)
            continue
        if closing:
            if tag != "p" and opened[tag]:
                while stack:
                    name, was_bad, was_good, named, items = stack.pop()
                    opened[name] -= 1
                    bad, good = bad - was_bad, good - was_good
                    if name == tag:
                        break
        elif (names := _bad_names(attrs)) or tag in BLOCK_TAGS and tag != "p":
            is_bad = tag in BAD_TAGS or tag == "header" and not good
            if tag in ("html", "body", "article", "main"):
                names = set()
            elif good:  # the article's own headline
                names = names - {"header"}
            if tag == "body":
                bad = named = items = good = 0
                stack.clear()
                opened.clear()
            if tag == "p":  # a paragraph is over where the next block begins
                block = cut(tag)
                block.named = block.named or bool(names) and not block.bad
                block.bad |= bool(names)
                continue
            opened[tag] += 1
            stack.append((tag, int(is_bad), int(tag in GOOD_TAGS), named, items))
            if tag in GOOD_TAGS and not good and (tag == "main" or not items):  # its place says more than a wrapper's name
                named = items = 0
            bad, good = bad + int(is_bad), good + int(tag in GOOD_TAGS)
            named, items = named + bool(names), items + bool(names & ITEM_NAMES)
        if tag in BLOCK_TAGS:
            block = cut(tag)
    unclosed = _OPEN.search(page, max(pos, end_of_tags))  # a tag that never ends is no text
    add(page[pos : unclosed.start() if unclosed else len(page)])
    cut("")
    return out


def classify(blocks: list[_Block]) -> None:
    """Give each block the label ``good`` or ``bad``."""
    for b in blocks:
        size = len(b.text)
        share = b.linked / max(1, len(b.text.replace(" ", "")))
        if b.bad or b.text[0] == "©":
            b.label = "bad"
        elif b.good:
            b.label = "good" if share <= ARTICLE_LINK_MAX else "bad" if b.tag == "li" else "open"
        elif share > LINK_MAX:
            b.label = "bad"
        elif size < SHORT_CHARS:
            b.label = "bad" if b.linked else "open"
        else:
            words = _WORD.findall(b.text.lower())
            density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            if density >= STOP_HIGH and size >= LONG_CHARS:
                b.label = "good"
            elif density >= STOP_LOW:
                b.label = "near"
            else:
                b.label = "bad"
    article = any(b.good and b.label == "good" for b in blocks)
    if article:  # the page says where its article is
        for b in blocks:
            if not b.good:
                b.label = "bad"
    decided = lambda b: b.label in ("good", "bad") and (not article or b.good and not b.bad)  # noqa: E731  what isn't the article's own says nothing of its blocks
    edge = "good" if article else "bad"
    before, seen = [], edge
    for b in blocks:
        before.append(seen)
        seen = b.label if decided(b) else seen
    after, seen = [], edge
    for b in reversed(blocks):
        after.append(seen)
        seen = b.label if decided(b) else seen
    for b, prev, nxt in zip(blocks, before, reversed(after), strict=True):
        if b.label == "open":
            b.label = "good" if prev == nxt == "good" or nxt == "good" and b.tag[:1] == "h" and b.tag[1:].isdigit() else "bad"
        elif b.label == "near":
            b.label = "good" if "good" in (prev, nxt) else "bad"
    for named, least, density in ((False, SHORT_CHARS, STOP_LOW), (True, LONG_CHARS, STOP_HIGH)):
        if any(b.label == "good" for b in blocks):
            break
        for b in blocks:  # a page with doubtful blocks only: its running text, and then that which only a name calls bad
            if (b.named if named else not b.bad) and b.linked == 0 and b.text[0] != "©" and len(b.text) >= least:
                words = _WORD.findall(b.text.lower())
                if sum(w in STOP_WORDS for w in words) >= density * max(1, len(words)):
                    b.label = "good"


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


@F.pandas_udf(T.StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def main_text_column(html_col: str) -> Column:
    """The main text of the pages in the column ``html_col``; never null."""
    return _main_texts(F.col(html_col))


def html_extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row for each row of ``df``: its ids, ``text`` and ``n_chars``, the text's code points."""
    return df.select(*id_cols, main_text_column(html_col).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extract": op9_html_extract}
ORACLES: dict[str, str] = {}
