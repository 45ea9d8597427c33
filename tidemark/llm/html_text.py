"""Operator 7: main text of web pages by line-block distribution.

A page becomes lines, one for each block element. Elements that never hold main text (scripts, styles, navigation, forms
and the like, by tag or role, and hidden ones) are stripped; such a line stays as a place without text. An element whose
class or id names such a thing as a whole word (``site-footer``, ``comment-list``, not ``has-sidebar`` or
``comments-open``) is stripped too, unless it holds most of the text there is: words are hints, the text decides.

Lines have weights, summed over sliding windows of WINDOW lines. A line weighs its length; on pages that mark their
article (``article``, ``main`` or the like) only its lines weigh, on others a line that ends a sentence weighs SURGE
more, and one that is mostly links, or a short copyright line, nothing. WINDOW or more lines in a row that are mostly
links are a menu and weigh nothing anywhere. A surge is a line with weight whose window weighs SURGE or more (or half of
the heaviest window, on pages of short lines); it lasts until the dive, where a window weighs nothing. In a marked
article all that lies between two dives with a surge is main text; elsewhere it goes from the first surge to the last
dive, without menus, and surges that stand amid links don't count.

Defined cases: a null page counts as empty; a page without text gives the empty string; markup that isn't closed ends
with its parent or the page; character references are decoded within each piece of text, so none spans a tag; very long
and very deep pages take time in proportion to their length; equal regions are all kept; repeated rows give equal
results; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Lines that a window spans, and the weight of a window from which text surges.
WINDOW, SURGE = 3, 80
#: Share of a line's characters in links from which it weighs nothing, on unmarked pages.
LINKED = 0.6
ENDS_SENTENCE = re.compile(r"[.!?\u2026:;\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*$")
#: A line of at most so many characters that begins with a mark or with a year after the word.
COPYRIGHT = re.compile(r"^\W*(?:\u00a9|\(c\)|copyright\s+(?:\u00a9|\(c\)|[12]\d{3}\b))|\ball rights reserved\b", re.I)
NOTICE = 200

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What closes an open p; li, dt and dd, and table cells close their like.
CLOSES_P = BLOCKS - {"body", "html", "head"}
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
LIKE_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}}

#: Elements that never hold main text, and roles that say so.
NEVER = frozenset("nav header footer aside form button select menu dialog object embed canvas audio video label".split())
ROLES_NEVER = frozenset("navigation banner contentinfo complementary search searchbox dialog alertdialog menu menubar toolbar form".split())
#: Words for what isn't main text: by themselves or as the last of a compound; the second only by themselves.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer header masthead topbar toolbar comment comments commentlist respond replies disqus pagination pager skiplink searchbox "
    "searchform tagcloud taglist notice notices copyright".split()
)
ALONE = frozenset("share sharing social related recommended recommendations alert".split())
#: What may follow either in a compound, and what takes it back before it.
PLACES = frozenset(
    "list lists box boxes wrap wrapper container area section block bar menu form item items link links inner button buttons icon icons slot unit banner zone panel post posts article articles story stories widget content body thread share sharing media".split()
)
TAKEN_BACK = frozenset("has no non not with without is in on hide hides show shows js can".split())
#: Names that mean something else inside an article; names of readers' comments; names of articles that aren't the page's.
WITHOUT = frozenset("header masthead banner login signup copyright".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
OTHER_ARTICLES = frozenset("comment comments reply related recommended ad ads advert sponsored promo teaser widget".split())
SAYS_MAIN = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?(?:body|content)|entry-?content|main-?content|article-?content|story-?body)(?:$|[\s_-])", re.I)


def named(value: str, within: bool) -> str | None:
    """The word of a class or id that names what isn't main text."""
    for token in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        if not parts or parts[0] in TAKEN_BACK:
            continue
        if len(parts) == 1:
            if parts[0] in NAMES | ALONE and not (within and parts[0] in WITHOUT):
                return parts[0]
        elif within and len(parts) == 2 and parts[1] in ("notice", "notices"):
            if parts[0] in NAMES:
                return parts[1]
        elif parts[-1] in NAMES and not (within and parts[-1] in WITHOUT):
            return parts[-1]
        else:
            for i, word in enumerate(parts[:-1]):
                if word in NAMES | ALONE and not (within and word in WITHOUT) and all(x in PLACES for x in parts[i + 1 :]):
                    return word
    return None


#: An attribute's value is quoted only right after its equals sign; elsewhere quotes are plain characters.
VALUES = r"""(?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>])"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({VALUES}*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|aria-label|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def _role(tag: str, attributes: str, within: bool) -> tuple[int, str | None]:
    """-1 for an element without main text, 1 for one that marks it, 0 for others; and the name by which it may be stripped."""
    if tag in NEVER and not (within and tag == "header"):
        return -1, None
    said, name = (1 if tag in ("article", "main") else 0), None
    if attributes and tag not in ("body", "html"):
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return -1, None
            if kind == "role":
                if value.lower() in ROLES_NEVER:
                    return -1, None
                said = 1 if value.lower() in ("main", "article") else said
            elif kind in ("class", "id"):
                if said and tag in ("article", "main"):
                    name = name or next((t for t in value.lower().split() if t in OTHER_ARTICLES), None)
                else:
                    name = name or named(value, within)
                said = 1 if SAYS_MAIN.search(value) else said
            elif kind == "itemprop" and value.lower() == "articlebody":
                said = 1
    return said, name


@dataclass
class Line:
    """A block's text, its characters in links, whether the page marks it as main text, and the named elements it is in."""

    text: str
    linked: int = 0
    main: bool = False
    within: tuple[int, ...] = ()


def lines_of(page: str) -> list[Line]:
    """The lines of a page; text "" where elements or names strip it."""
    lines: list[Line] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, int]] = []  # open elements, their roles, the numbers of the named ones or -1
    names: list[str] = []
    opened: Counter[str] = Counter()
    inside: list[int] = []
    never = main = links = 0

    def end_line() -> None:
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                lines.append(Line(text, sum(len(x) for x, a in parts if a), main > 0, tuple(inside)))
            parts.clear()

    def close(upto: int) -> None:
        nonlocal never, main, links
        while len(stack) > upto:
            tag, role, number = stack.pop()
            opened[tag] -= 1
            never -= role < 0
            links -= tag == "a"
            if tag in BLOCKS or role < 0 or number >= 0:
                end_line()
                if role < 0 and not never:
                    lines.append(Line(""))
            if number >= 0:
                inside.pop()
            main -= role > 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not never:
            text = page[at : m.start() if m else n]
            if text:
                parts.append((html.unescape(text) if "&" in text else text, links > 0))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "table", "body") and tag not in BLOCKS:
                    break
            if tag == "p" or tag in BLOCKS:
                end_line()
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            if not never:
                parts.append((" ", False))
            continue
        if tag in CLOSES_P:
            end_line()
            for i in range(len(stack) - 1, -1, -1) if opened["p"] > 0 else ():
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in LIKE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in LIKE[tag]:
                    close(i)
                    if tag != "tr":
                        break
                elif stack[i][0] in LIKE_WITHIN[tag]:
                    break
        if tag in VOID:
            continue
        role, name = _role(tag, m[3], main > 0)
        if role and (role < 0 or tag in BLOCKS) or name:
            end_line()
        # names below a named element say no more than it does: an element of each of few kinds is open at once
        number = -1
        if name and not never and len(inside) < DEEPEST:
            number = len(names)
            names.append(name)
            inside.append(number)
        stack.append((tag, role, number))
        opened[tag] += 1
        never += role < 0
        main += role > 0
        links += tag == "a"
    close(0)
    end_line()
    return stripped(lines, names)


#: Named elements that may be open within each other; what is named below goes with them.
DEEPEST = 16


def stripped(lines: list[Line], names: list[str]) -> list[Line]:
    """The lines without the text of named elements; one that holds most of the page's text (comments: if all text is within names) stays."""
    if not names:
        return lines
    marked = any(x.main for x in lines)
    held, total, bare = [0] * len(names), 0, 0
    for x in lines:
        if x.main or not marked:
            total += len(x.text)
            bare += 0 if x.within else len(x.text)
            for i in x.within:
                held[i] += len(x.text)
    stays = [2 * held[i] > total and (name not in COMMENTS or not bare) for i, name in enumerate(names)]
    out = []
    for x in lines:
        if all(stays[i] for i in x.within):
            out.append(x)
        elif not out or out[-1].text or x.within != out[-1].within:
            out.append(Line("", 0, False, x.within))  # one place for each element
    return out


def menus(lines: list[Line]) -> list[bool]:
    """Whether a line is one of WINDOW or more in a row that are mostly links: such a window weighs nothing."""
    out, run = [False] * len(lines), 0
    for i, x in enumerate([*lines, Line("")]):
        if x.text and x.linked > LINKED * len(x.text):
            run += 1
            continue
        if run >= WINDOW:
            out[i - run : i] = [True] * run
        run = 0
    return out


def weights_of(lines: list[Line], menu: list[bool]) -> list[int]:
    marked = any(x.main and x.text for x in lines)

    def weight(x: Line, amid: bool) -> int:
        if marked:
            return 0 if amid or not x.main else len(x.text)
        if x.linked > LINKED * len(x.text) or len(x.text) <= NOTICE and COPYRIGHT.search(x.text):
            return 0
        return len(x.text) + (SURGE if ENDS_SENTENCE.search(x.text) else 0)

    return [weight(*x) for x in zip(lines, menu, strict=True)]


def regions(weights: list[int], whole: bool = False) -> list[tuple[int, int]]:
    """[surge, dive) of each run of lines that begins where a window is heavy and lasts until one weighs nothing.

    whole: a run that surges counts from its first line with weight.
    """
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]  # of the window that begins at a line
    least = min(SURGE, max(sums, default=0) / 2)
    found, i, run = [], 0, 0
    while i < n:
        run = i + 1 if not sums[i] else run
        if not weights[i] or sums[i] < least:
            i += 1
            continue
        surge = next(k for k in range(run, i + 1) if weights[k]) if whole else i
        while i < n and sums[i]:
            i += 1
        dive = i
        while not weights[dive - 1]:
            dive -= 1
        found.append((surge, dive))
    return found


def amid_links(lines: list[Line], a: int, b: int) -> bool:
    """Whether most of the text of a region and of the lines next to it, which have no text of their own, is in links."""
    around = lines[max(0, a - WINDOW) : b + WINDOW]
    return 2 * sum(x.linked for x in around) > sum(len(x.text) for x in around)


def main_text(page: str) -> str:
    lines = lines_of(page)
    marked = any(x.main and x.text for x in lines)
    if marked:
        lines = [x for x in lines if x.text]  # what is stripped inside an article is no gap in it
    menu = menus(lines)
    weights = weights_of(lines, menu)
    found = regions(weights, marked)
    if marked:
        kept = [i for a, b in found for i in range(a, b) if weights[i]]
    else:
        like = [x for x in found if not amid_links(lines, *x)] or found
        kept = [i for i in range(like[0][0], like[-1][1]) if lines[i].text and not menu[i]] if like else []
    return "\n\n".join(lines[i].text for i in kept)


def extract(df: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """Columns ``keep`` of df and ``text``, the main text of the page."""
    kinds = dict(df.dtypes)

    def start() -> Callable[..., tuple]:
        return lambda value, *kept: (*kept, main_text(value or ""))

    return map_rows(df.select(page, *keep), ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string"]), start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
