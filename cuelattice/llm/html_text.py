"""Main text of web pages by two-pass block rules.

A page becomes a list of text blocks. The first pass decides the clear ones by their surroundings, link density,
length and share of stop words; the second gives each ambiguous, mostly short block the label of its nearest decided
neighbours.

Kinds of elements and roles around an article settle what they hold. Names in a class or id are evidence: what they hold
is left out, unless the name is one that articles bear too (``reader``, ``legal``, ``notice``, ...) and it holds more good
text than the rest of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import small_batches

# Common function words of six languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can could for from had has have he her his how i if in into
    is it its more no not of on one or our out over said she so some than that the their them then there they this to
    up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par
    pas plus pour qu que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei bis das dass dem den der die dies durch ein eine einem einen einer er es für hat ich
    im ist mit nach nicht noch nur oder sich sie sind so um und uns unter vom von vor war wie wird zu zum zur über
    al algo como con cuando del desde donde el ella entre era esta este fue ha hay las lo los más me mi muy nos o para
    pero por porque ser si sin sobre son su sus también tiene todo y ya
    che di e gli i il non per della una dei nel alla com das do dos em não os uma
    aan dat een het maar naar niet of ook te van voor zijn
    """.split()
)
# Elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math textarea title canvas audio video applet noframes select datalist".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button head".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs crumbs sidebar sidebars rail aside footer foot masthead topbar header
    comment comments commentlist disqus respond reply replies reader responses discussion cookie cookies consent gdpr notice
    notices notification alert popup modal overlay newsletter subscribe subscription signup login register share sharing social
    related recommended recommendations trending popular widget widgets toolbar pagination pager copyright legal disclaimer skip
    search form tags tagcloud byline
    """.split()
)
#: Those of the names that elements around whole articles bear too.
WEAK_NAMES = frozenset(
    """
    reader responses reply replies respond discussion notice notices notification alert search form popular trending related recommended
    recommendations legal disclaimer copyright widget widgets share sharing social login register skip byline header banner tags foot
    promotion promoted masthead toolbar pager pagination rail
    """.split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
LAYOUT_NAMES = frozenset("has with no without layout page wrapper container body site".split())

SHORT, LONG = 70, 200
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.12, 0.22
FEW_IN_ARTICLE = 0.05
MOST_LINKED, LINKED_IN_SHORT = 0.33, 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SENTENCE = re.compile(r"[.!?](?=\s|$)|[。！？।۔]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    region: int
    heading: bool
    named: tuple[int, ...] = ()  # numbers of the elements around it whose names speak against it; below zero: beyond doubt
    label: str = ""

    @property
    def link_density(self) -> float:
        return self.linked / max(len(self.text), 1)


def _surroundings(name: str, rest: str, in_article: bool) -> tuple[bool, set[str]]:
    """Whether an element is one of the things around an article by its kind, role or visibility; names that speak for it."""
    if name in OUTSIDE or (name == "header" and not in_article):
        return True, set()
    if not rest.strip(" /"):
        return False, set()
    attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True, set()
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True, set()
    if attributes.get("role", "").lower() in OUTSIDE_ROLES:
        return True, set()
    if name in ("html", "body", "main", "article") or name in HEADINGS:
        return False, set()
    names = {x.lower() for x in _NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")}
    if in_article:
        names.discard("header")
    return False, set() if names & LAYOUT_NAMES else names & OUTSIDE_NAMES


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed and crossed elements are read leniently."""
    out: list[Block] = []
    buffer: list[str] = []
    linked: list[str] = []
    # Element, outside, number of the article or main element around it, numbers of named elements around it.
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []
    outside, region, regions, link, named, numbers = False, 0, 0, 0, (), 0
    heading = ""

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append(Block(text, len(" ".join(html.unescape("".join(linked)).split())), outside, region, bool(heading), named))
            buffer, linked = [], []

    def say(text: str) -> None:
        if text:
            buffer.append(text)
            if link:
                linked.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["data"] is not None:
            say(html.escape(m["data"]))
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closes, rest = bool(m["close"] or m["close2"]), m["rest"] or m["rest2"] or ""
        if not closes and name in UNSEEN:
            if not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name not in ("select", "object", "video", "audio", "canvas"):
                    at = end
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            link = 0 if closes else 1
            continue
        block = name in BLOCKS
        if not block and name in VOID:
            continue
        if block:
            flush()
            heading = "" if closes else name if name in HEADINGS else heading if name in ("a", "span") else ""
        if closes:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0:
                # An inline element's end closes no block.
                if not block and any(x[0] in BLOCKS for x in stack[depth + 1 :]):
                    continue
                before = stack[depth - 1] if depth else ("", False, 0, ())
                if block or (stack[depth][1], stack[depth][3]) != (before[1], before[3]):
                    flush()
                del stack[depth:]
                link = 0 if block else link
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
            within = stack[-1] if stack else ("", False, 0, ())
            around, names = within[2], within[3]
            out_here, said = _surroundings(name, rest, bool(around))
            out_here = within[1] or out_here
            if said and not out_here:
                numbers += 1
                names = (*names, numbers if said <= WEAK_NAMES else -numbers)
            if not block and (out_here, names) != (within[1], within[3]):
                flush()
            if name in INSIDE and not out_here and not around and not any(k < 0 for k in names):
                regions += 1
                around = regions
            stack.append((name, out_here, around, names))
        _, outside, region, named = stack[-1] if stack else ("", False, 0, ())
    flush()
    return out


def stop_share(b: Block) -> float:
    spoken = [w.strip(".,;:!?\"'()«»„“”").lower() for w in b.text.split()]
    return sum(w in STOP_WORDS for w in spoken) / max(len(spoken), 1)


def prose(b: Block) -> bool:
    """Whether a block of an unknown language reads like text: a sentence end for each 300 characters or less."""
    return len(_SENTENCE.findall(b.text)) * 300 >= len(b.text)


def first_pass(b: Block, known: bool = True) -> str:
    """``good``, ``bad``, or an ambiguous ``near`` or ``short``; by sentence ends where no stop word is ``known``."""
    if b.outside:
        return "outside"
    n = len(b.text)
    if b.link_density > MOST_LINKED:
        return "bad"
    if n < SHORT:
        return "bad" if b.link_density > LINKED_IN_SHORT else "short"
    if not known:
        return ("good" if b.region or n > LONG else "near") if prose(b) else "near" if b.region else "bad"
    stops = stop_share(b)
    if b.region:
        return "good" if stops >= FEW_IN_ARTICLE else "near"
    if stops >= MANY_STOP_WORDS:
        return "good" if n > LONG else "near"
    return "near" if stops >= FEW_STOP_WORDS else "bad"


def _speaks_known(blocks: list[Block]) -> bool:
    """Whether any block has the stop words of a language at hand; a page without is judged without them."""
    return any(len(b.text) >= SHORT and not b.outside and stop_share(b) >= FEW_STOP_WORDS for b in blocks)


def admitted(blocks: list[Block]) -> set[int]:
    """Numbers of named elements that hold more text of articles than the rest of the page, outer ones first: their names say nothing."""
    known = _speaks_known(blocks)
    good = [b for b in blocks if first_pass(b, known) in ("good", "near")]
    kept: set[int] = set()
    for k in sorted({k for b in good for k in b.named if k > 0}):
        size = lambda chosen: sum(len(b.text) for b in good if chosen(set(b.named) - kept))
        if size(lambda left: left == {k}) > size(lambda left: not left):
            kept.add(k)
    return kept


def classify(blocks: list[Block]) -> list[Block]:
    """Labels every block ``good`` or ``bad`` (``outside``: decided by what surrounds it)."""
    if any(b.named for b in blocks):
        kept = admitted(blocks)
        for b in blocks:
            b.outside = b.outside or not kept.issuperset(b.named)
    known = _speaks_known(blocks)
    for b in blocks:
        b.label = first_pass(b, known)
    inside = [b for b in blocks if b.label != "outside"]
    framed = any(b.region and b.label in ("good", "near", "short") for b in inside)
    for b in inside:
        if framed and not b.region:
            b.label = "bad"  # a page that marks its article has no other
    decided = [b.label if b.label in ("good", "bad") else "" for b in inside]
    before, after = [""] * len(inside), [""] * len(inside)
    last = ("", 0)
    for i, b in enumerate(inside):
        before[i] = last[0] if last[1] == b.region else ""
        last = (decided[i], b.region) if decided[i] else last
    last = ("", 0)
    for i in range(len(inside) - 1, -1, -1):
        after[i] = last[0] if last[1] == inside[i].region else ""
        last = (decided[i], inside[i].region) if decided[i] else last
    for b, was, comes in zip(inside, before, after, strict=True):
        if b.label in ("near", "short"):
            if b.region:
                b.label = "bad" if was == comes == "bad" else "good"
            elif was == comes:
                b.label = was or "good"
            elif b.heading:
                b.label = comes or was
            elif not was or not comes:
                b.label = was or comes
            else:
                b.label = "good" if b.label == "near" else "bad"
    return blocks


def main_text(page: str) -> str:
    return "\n\n".join(b.text for b in classify(blocks_of(page)) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html, more columns stay) with ``text`` and ``n_chars``, its length in code points.

    Null, empty and unreadable pages have an empty text; columns of these names that ``pages`` already has are replaced.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) if x else "" for x in s], dtype=object)

    out = pages.withColumn("text", text(F.coalesce("html", F.lit(""))))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
