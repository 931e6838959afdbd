"""Main text of web pages by two-pass block rules.

A page is cut into blocks (paragraphs, headings, list items, cells ...).
Blocks inside navigation, page headers and footers, sidebars, forms and the
like, by element or by the words of their class, id and role, are never
text, but a class word does not take the page's article, main or most of its
text away (``_lifted``).  The first pass labels the others by link density, length and
stop-word density as good, bad, near-good or short; the second lets the
undecided ones (short, near-good) take the labels of the nearest decided
neighbours of the same section.  Inside a page's <article> or <main> text is
expected: a block that only lacks stop words is undecided there rather than
bad, and the section's ends count as good neighbours; and where these sections
hold at least as much text as the rest of the page, the rest goes.  A page
without any block of known stop words (another language, figures) is judged by
length and link density alone.

Defined results: character references are decoded; any white space inside
a block is one space, blocks are trimmed and joined by one space in page
order; null or empty html and pages without text give an empty string;
unclosed elements end with their parent, a head at what cannot stand in it,
raw text (scripts, styles, titles, text areas, frames) with the page; repeated rows are rows; an empty
table gives no rows; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Function words of English, French, German and Spanish (fixed values).
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in
into is it its more no not of on one or our out she so some such than that the their them then there these they this to
was we were what when which who will with would you your
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que
qui sa sans se ses son sont sur tout un une vous été être
aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im
in ist man mit nach nicht noch nur oder sein sich sie sind so über um und unter vom von vor war was wenn werden wie wir zu
zum zur
al como con del el ella en entre era es esta este fue ha hay la las lo los más muy no nos o para pero por porque que se
ser si sin sobre su sus también te un una y ya
""".split())
#: Elements whose content is never text: raw text up to the end tag, and elements that nest; and elements that are page furniture.
RAW = frozenset("script style iframe title textarea".split())
PHRASING = frozenset("svg math canvas select option datalist button audio video map".split())  # no article or main stands in these
SILENT = PHRASING | {"noscript", "template", "object"}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FURNITURE = frozenset("nav footer aside form menu dialog header".split())
#: Elements that start and end a block.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark furniture.
MARKS = frozenset("""ad ads adbox advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs byline-social comment comments
commentlist consent cookie cookies disqus dropdown footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices
overlay pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidenav
signup skip social sponsor sponsored subscribe tagcloud tags toolbar topbar widget widgets complementary contentinfo""".split())
#: Marks of parts that hold what readers wrote, often more than the page's own text; first and last parts of class words that tell a state.
REPLIES = frozenset("comment comments commentlist disqus replies reply respond".split())
STATE_FIRST = frozenset("no not without has have with".split())
STATE_LAST = frozenset("free open opened closed collapsed enabled disabled".split())
#: First pass: link density above which a block is bad, lengths in characters, stop-word densities.
MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.15, 0.30
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CLOSES_P = BLOCK - {"body", "html"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    section: int = 0
    label: str = ""


@dataclass
class Mark:
    """A class word's element: whether the whole word is a mark, whether it marks replies, text and articles in it."""
    at: int
    whole: bool
    replies: bool
    text: int = 0
    articles: int = 0
    mains: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)
    text: int = 0  # characters, without white space, that are not skipped
    free: int = 0  # of these, outside marks
    lost: int = 0  # characters skipped
    articles: int = 0
    mains: int = 0
    free_articles: int = 0
    free_mains: int = 0
    lost_articles: int = 0


def _furniture(tag: str, attrs: str, in_article: bool, at: int) -> bool | Mark:
    """True for elements that never hold text, a Mark for a class word's."""
    if tag in FURNITURE and not (tag == "header" and in_article):
        return True
    if not attrs:
        return False
    mark = None
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), unescape(a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = _SPLIT.split(word)
                if word not in MARKS and len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
                    continue
                hit = MARKS.intersection(parts) or ({word} if word in MARKS else set())
                if not hit and not in_article and "header" in parts and not {"article", "post", "entry"}.intersection(parts):
                    hit = {"header"}
                if hit:
                    mark = mark or Mark(at, False, False)
                    mark.whole |= word in MARKS or word == "header"
                    mark.replies |= not REPLIES.isdisjoint(hit)
    return mark or False


def _lifted(page: Page) -> frozenset[int]:
    """Where marked elements begin that are no furniture: the page's only
    main or articles are in them, or, if the mark is only a part of a class
    word, most of the page's text."""
    return frozenset(
        m.at for m in page.marks
        if m.mains and not page.free_mains
        or not m.replies and (m.articles and not page.free_articles and m.text >= page.free or not m.whole and 2 * m.text > page.text))


def blocks(html: str) -> list[Block]:
    """The blocks outside furniture, with text, linked characters and section
    (0 outside article and main elements)."""
    page = _parse(html, frozenset(), False)
    if page.marks and (page.lost_articles or page.lost > page.text):
        lifted = _lifted(_parse(html, frozenset(), True))
        if lifted:
            page = _parse(html, lifted, False)
    return page.blocks


def _parse(html: str, lifted: frozenset[int], survey: bool) -> Page:
    """One pass over the page; marked elements are skipped if not lifted.  A
    survey skips none of them and counts what is in them."""
    page = Page()
    stack: list[tuple[str, bool, int, Mark | None]] = []  # element, skipped, section outside, counted mark
    open_: dict[str, int] = {}  # elements of a name in the stack
    block, section, sections, links, skip, marked, at = Block(), 0, 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            block.text, block.section = text, section
            page.blocks.append(block)
        block = Block()

    def pop_to(k: int) -> None:
        nonlocal section, links, skip, marked
        if any(t in BLOCK for t, *_ in stack[k:]):
            flush()
        for tag, bad, outer, mark in reversed(stack[k:]):
            skip -= bad
            links -= tag == "a"
            section = outer
            open_[tag] = open_.get(tag, 1) - 1
            if mark:
                marked -= 1
                mark.text, mark.articles, mark.mains = page.text - mark.text, page.articles - mark.articles, page.mains - mark.mains
        del stack[k:]

    def say(raw: str) -> None:
        if not raw:
            return
        if skip:
            page.lost += len(raw)
            return
        text = unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        n = len("".join(text.split()))
        page.text += n
        if not marked:
            page.free += n
        if links:
            block.linked += n

    def first(names: frozenset[str]) -> int:
        return next(i for i, entry in enumerate(stack) if entry[0] in names)

    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        say(html[at:m.start() if m else size])
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if open_.get(tag) else -1
            if k >= 0:
                # an inline end tag does not close the blocks around it
                if tag in BLOCK or tag in SILENT or tag == "head" or not any(t in BLOCK for t, *_ in stack[k + 1:]):
                    pop_to(k)
                else:
                    links -= tag == "a"
                    open_[tag] -= 1
                    stack[k] = ("", *stack[k][1:])
            elif tag in BLOCK:
                flush()
            continue
        closed = attrs.rstrip().endswith("/")
        foreign = open_.get("svg") or open_.get("math")
        if open_.get("head") and (tag == "body" or stack[-1][0] == "head" and tag not in IN_HEAD):
            pop_to(first(frozenset({"head"})))
        if foreign and tag in BLOCK and not any(open_.get(t) for t in ("foreignobject", "desc", "annotation-xml")):
            pop_to(first(frozenset({"svg", "math"})))
        if tag in ("article", "main") and any(open_.get(t) for t in PHRASING):
            pop_to(first(PHRASING))
        if tag in RAW:
            if foreign and closed:
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else size
            continue
        if tag in BLOCK or tag == "br":
            if tag == "br":
                say(" ")
                continue
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCK or stack[i][0] in ("object", "template") or stack[i][0] == "button" and tag != "p":
                        break
            if tag in _SAME:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _SAME[tag]:
                        pop_to(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "menu", "article", "main", "body"):
                        break
            flush()
        if tag in VOID or closed and tag not in BLOCK and (foreign or tag not in SILENT or tag in ("svg", "math")):
            continue
        if tag in ("article", "main"):
            is_main = tag == "main"
            page.articles += not skip and not is_main
            page.mains += not skip and is_main
            page.lost_articles += bool(skip)
            page.free_articles += not skip and not marked and not is_main
            page.free_mains += not skip and not marked and is_main
        found = not skip and (tag in SILENT or _furniture(tag, attrs, section > 0, m.start()))
        mark = None
        if isinstance(found, Mark):
            page.marks.append(found)
            if survey:
                mark, found.text, found.articles, found.mains = found, page.text, page.articles, page.mains
                marked += 1
            found = not survey and found.at not in lifted
        stack.append((tag, bool(found), section, mark))
        open_[tag] = open_.get(tag, 0) + 1
        skip += bool(found)
        links += tag == "a"
        if tag in ("article", "main") and not section:
            sections += 1
            section = sections
    flush()
    pop_to(0)
    return page


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def classify(found: list[Block]) -> None:
    """Both passes."""
    shares = [_stop_share(b.text) for b in found]
    known = any(s >= STOP_LOW and len(b.text) >= SHORT and b.linked <= MAX_LINKS * len(b.text) for b, s in zip(found, shares))
    for b, share in zip(found, shares):
        n, stops = len(b.text), share if known else STOP_HIGH
        if b.linked > MAX_LINKS * max(1, n - b.text.count(" ")):
            b.label = "bad"
        elif n < SHORT:
            b.label = "bad" if b.linked and not b.section else "short"
        elif stops >= STOP_HIGH:
            b.label = "good" if n > LONG or b.section else "near"
        elif stops >= STOP_LOW or b.section:
            b.label = "near"
        else:
            b.label = "bad"
    marked = [b.label if b.label == "good" or b.label == "bad" and not b.section else "" for b in found]
    none = "good" if not any(marked) else "bad"  # what the ends of a page without an article count as

    def nearest(order: list[int]) -> dict[int, tuple[str, int]]:
        """For each block the nearest decided label along ``order`` in its section, and how far it is."""
        out, label, far, section = {}, "", 0, -1
        for i in order:
            b = found[i]
            if b.section != section:
                label, far, section = "good" if b.section else none, 0, b.section
            far += 1
            out[i] = (label, far)
            if marked[i]:
                label, far = marked[i], 0
        return out
    up, down = nearest(list(range(len(found)))), nearest(list(range(len(found) - 1, -1, -1)))
    for i, b in enumerate(found):
        if b.label in ("short", "near"):
            (x, far_x), (y, far_y) = up[i], down[i]
            near_good = b.label == "near" and "good" in (x, y)
            b.label = "good" if near_good else x if far_x < far_y else y if far_y < far_x else "good" if "good" in (x, y) else "bad"


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    classify(found)
    good = [b for b in found if b.label == "good"]
    inside = [b for b in good if b.section]
    if any(b.section for b in found) and 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in good):
        good = inside  # the marked article holds most of the text, so the rest is not the page's
    return " ".join(b.text for b in good)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text."""
    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(main_text)
    return pages.withColumn(out, run(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))


def query(pages: DataFrame) -> DataFrame:
    """Contract columns of op5, one row per page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
