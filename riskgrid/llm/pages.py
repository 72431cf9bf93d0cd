"""Main text of web pages.

Method: two-pass block rules. A page is cut into blocks with their containers,
link text and stop words. The first pass decides blocks by container, link
density, length and stop-word density and leaves short or unclear ones open;
in the second, open blocks inherit from their nearest decided neighbours. Tags,
roles and hidden state rule blocks out; names in class and id only do so for a
small part of the page. The time is linear in the page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, table

#: Limits of the first pass: words of a short and of a long block, and densities.
SHORT_WORDS = 10
LONG_WORDS = 30
MOST_LINKS = 0.5
LEAST_STOP = 0.15
FULL_STOP = 0.25
#: Share of the plain text from which a class or id no longer says that an element is boilerplate.
HINTED_SHARE = 0.25
READER_SHARE = 0.05
#: Share of stop words below which a page's running text is in a language that STOP_WORDS lacks.
FOREIGN_STOP = 0.05
#: Characters from which a block without spaces counts as long.
LONG_CHARS = 60

# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it
its just may me more most my no not of on one only or other our out over she should so some such than that the their them then there these
they this those to under up was we were what when which who will with would you your
aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dem den der des die dies diese dieser doch du durch ein eine
einem einen einer eines er es für hat hatte ich ihr im in ist ja kann kein keine mehr mich mir mit nach nicht noch nur oder schon sehr sein
seine sich sie sind so über um und uns unter vom von vor war waren was wenn wer wie wir wird zu zum zur
au aux avec avait ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur leurs lui ma mais me même mes mon ne
nos notre nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sous sur te tes toi ton tu un une vos votre vous y été
al algo como con cual cuando del desde donde el ella ellos entre era es esa ese eso esta este esto fue ha hay las lo los más mi muy ni nos
o otra otro para pero por porque quien se ser si sin sobre son su sus también tan te tiene todo un una uno unos y ya yo
che chi con da dal della delle di gli ha il lei lo nel nella non per più quale questa questo sono sul tra un una
ao as com como da das do dos e em foi isso mais mas na nas no não nos os ou para pela pelo por que se sem ser sua são um uma
aan bij dat de deze die dit door een en er het hij ik is maar met naar niet nog ook op te tot uit van voor was werd wordt ze zijn
""".split())

_VOID = frozenset("area base basefont bgsound br col embed frame hr image img input keygen link meta param source track wbr".split())
_BLOCK = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1
h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot
th thead tr ul
""".split())
#: Elements whose text is never the article's, whatever it says; a page header counts only outside an article.
_BOILER_TAGS = frozenset("nav footer aside form menu dialog button select fieldset label search head".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in a class or id that hint at boilerplate. They are one feature: see decide().
_HINT_WORDS = frozenset("""
ad ads advert advertisement advertising adverts advertorial banner breadcrumb breadcrumbs comment comments consent cookie cookies
commentlist copyright dialog discussion disqus donate feedback footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification
overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup
social sponsor sponsored subscribe subscription teaser toolbar topbar widget disclaimer advertise
""".split())
#: Words for what readers write, and for what holds it; such parts may be longer than the article.
_READER_WORDS = frozenset("comment commentlist comments discussion disqus feedback replies reply respond".split())
_READERS = frozenset("customer guest reader readers user users".split())
_HOLDERS = frozenset("area block body box container content form item list section thread wrap wrapper".split())
_CONTENT_TAGS = frozenset(("article", "main"))
#: Blocks of one of these are decided together.
_GROUP_TAGS = frozenset("table ul ol dl pre".split())
#: Raw text that ends at its own closing tag or with the page, and content left out only where it is closed.
_RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
_SKIPPED_TAGS = frozenset("template svg math object canvas audio video".split())
_HEAD_TAGS = frozenset("base basefont bgsound link meta noscript script style template title".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>\"']*+)((?:[^\"'<>]++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD_CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th", "caption"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "caption"), "option": ("option",),
}
_SCOPE = frozenset("article aside body div dl fieldset footer form header html main menu nav ol section table ul".split())


class Block(NamedTuple):
    text: str
    words: int
    chars: int
    linked: int
    stops: float
    boiler: bool
    inside: bool
    heading: bool
    hint: int
    group: int


class Element(NamedTuple):
    tag: str
    boiler: bool
    inside: bool
    link: bool
    hint: int
    group: int


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Tags of a page as (start, end, closing, name, attributes); comments and declarations have no name.

    Most tags are simple; else quotes in a tag are honoured. Where they are broken the tag ends at the
    next ">", and a page on which such searches have cost four readings is read
    without quotes from there on, so the time is linear in the page's length.
    """
    at, n, budget = 0, len(page), 4 * len(page) + 1000
    gone: set[str] = set()

    def later(mark: str, start: int) -> int:
        found = -1 if mark in gone else page.find(mark, start)
        if found < 0:
            gone.add(mark)
        return found

    while (start := page.find("<", at)) >= 0:
        if m := _TAG.match(page, start):
            at = m.end()
            yield start, at, m[1] == "/", m[2].lower(), m[3]
            continue
        c = page[start + 1 : start + 2]
        if c == "!" or c == "?":
            if page.startswith("<!--", start):
                end = later("-->", start + 4)
                end = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", start):
                end = start + 9
            else:
                end = later(">", start)
                end = n if end < 0 else end + 1
            yield start, end, False, "", ""
            at = end
            continue
        close = c == "/"
        name = _NAME.match(page, start + 1 + close)
        first = later(">", start) if name else -1
        if first < 0:
            at = start + 1
            continue
        end, seek = first, name.end()
        while budget > 0 and (m := _STOP.search(page, seek)):
            if m[0] == ">":
                end = m.start()
                break
            shut = later(m[0], m.end())
            if shut < 0:
                budget -= m.end() - start
                break
            seek = shut + 1
        else:
            budget -= n - start
        yield start, end + 1, close, name[0].lower(), page[name.end() : end]
        at = end + 1


def _decisive(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is boilerplate by its name, role or hidden state."""
    if tag in _BOILER_TAGS or (tag == "header" and not inside) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return attributes.get("role", "").lower() in _BOILER_ROLES or bool(_HIDDEN.search(attributes.get("style", "")))


def _hint(tag: str, attributes: dict[str, str]) -> int:
    """0 without a hint word in class or id, 1 with one, 2 where a name says that readers wrote it."""
    if tag in ("html", "body", "main"):
        return 0
    strength = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORD_CUT.split(name) if w]
        if len(words) > 1 and words[-1] == "reviews" and words[-2] in _READERS:
            strength = 2
        if not _HINT_WORDS.isdisjoint(words):
            strength = max(strength, 1)
            if words[-1] in _READER_WORDS and words[0] not in ("no", "has", "with", "without") or words[0] in _READER_WORDS and words[-1] in _HOLDERS:
                strength = 2
    return strength


def blocks(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks of a page in order, white space made single, and its hinted elements as (strength, hinted element around, -1: none).

    Scripts, styles, comments and the head are left out. Elements are kept on a
    stack with the places of each name, so a closing tag finds its partner at
    once, however deep the page.
    """
    out: list[Block] = []
    hints: list[tuple[int, int]] = []
    stack = [Element("", False, False, False, -1, -1)]
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    parts: list[str] = []
    links: list[str] = []
    groups = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(entities.unescape("".join(links)).split()))
            words = text.count(" ") + 1
            stops = sum(w in STOP_WORDS for w in _LETTERS.findall(text.lower()))
            top = stack[-1]
            heading = any(len(x.tag) == 2 and x.tag[0] == "h" and x.tag[1].isdigit() for x in stack[-3:])
            out.append(Block(text, words, len(text), linked, stops / words, top.boiler, top.inside, heading, top.hint, top.group))
        parts.clear()
        links.clear()

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    def spoken(piece: str) -> None:
        parts.append(piece)
        if stack[-1].link:
            links.append(piece)

    at, n = 0, len(page)
    unclosed: set[str] = set()
    for start, end, close, tag, attributes in _tags(page):
        if start < at:
            continue
        if start > at:
            spoken(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            spoken(" ")
        if close:
            own = places.get(tag)
            if own and (tag in _BLOCK or not scopes or own[-1] > scopes[-1]):
                cut(own[-1])
            continue
        if tag in _RAW_TAGS or tag in _SKIPPED_TAGS:
            if attributes.endswith("/") and tag not in _RAW_TAGS or tag in unclosed:
                continue
            shut = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, end)
            past = page.find(">", shut.end()) + 1 if shut else 0
            if past:
                at = past
                spoken(" ")
            elif tag in _RAW_TAGS:
                at = n
                break
            else:
                unclosed.add(tag)
            continue
        if tag in _VOID:
            continue
        if stack[-1].tag == "head" and tag not in _HEAD_TAGS:
            cut(len(stack) - 1)
        closed = _CLOSES.get(tag, ("p",) if tag in _BLOCK else ())
        near = max((places[x][-1] for x in closed if places.get(x)), default=0)
        if near and (not scopes or near > scopes[-1]):
            cut(near)
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        top = stack[-1]
        given = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes and not attributes.isspace() else {}
        boiler = top.boiler or _decisive(tag, given, top.inside)
        hint = top.hint
        if not boiler and given and (strength := _hint(tag, given)):
            hints.append((strength, hint))
            hint = len(hints) - 1
        group = top.group
        if group < 0 and tag in _GROUP_TAGS:
            group, groups = groups, groups + 1
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(Element(tag, boiler, top.inside or (tag in _CONTENT_TAGS and not boiler), top.link or tag == "a", hint, group))
    if at < n:
        spoken(page[at:])
    flush()
    return out, hints


def _plain(b: Block) -> bool:
    """Text that isn't ruled out and isn't mostly links: what shares of the page are taken of."""
    return not b.boiler and b.linked <= MOST_LINKS * b.chars


def _running(b: Block) -> bool:
    return _plain(b) and b.words >= SHORT_WORDS and b.stops >= LEAST_STOP


def hinted(found: list[Block], hints: list[tuple[int, int]]) -> list[bool]:
    """Which blocks lie in an element whose class or id counts as a hint.

    A hint counts only for a small part of the page: an element that holds
    HINTED_SHARE of the page's plain text or more is no notice or side bar,
    whatever its name. What readers wrote may be longer than the article, so its
    hint counts unless less than READER_SHARE lies outside all hinted elements.
    """
    total, own, free = 0, [0] * len(hints), 0
    for b in found:
        if _plain(b):
            total += b.words
            if b.hint >= 0:
                own[b.hint] += b.words
            else:
                free += b.words
    for k in range(len(hints) - 1, -1, -1):
        if hints[k][1] >= 0:
            own[hints[k][1]] += own[k]
    counts = []
    for (strength, around), words in zip(hints, own):
        small = words < HINTED_SHARE * total or total == 0
        counts.append((around >= 0 and counts[around]) or small or (strength == 2 and free >= READER_SHARE * total))
    return [b.hint >= 0 and counts[b.hint] for b in found]


def _long(b: Block) -> bool:
    """Enough text to stand for itself in any language: many words, or many characters in a script without spaces."""
    return b.words >= LONG_WORDS or b.chars >= LONG_CHARS and b.chars >= 12 * b.words


def _foreign(found: list[Block]) -> bool:
    """Whether the page's text is in a language without stop words here: they are rare in what isn't ruled out."""
    plain = [b for b in found if _plain(b)]
    return sum(b.stops * b.words for b in plain) < FOREIGN_STOP * sum(b.words for b in plain)


def decide(found: list[Block], hints: list[tuple[int, int]]) -> list[bool]:
    """Which blocks are the article's.

    First pass: blocks in boilerplate elements, hinted blocks and blocks that are
    mostly links are not; blocks with enough words and stop words are, and on a
    page in a language without stop words here those with enough text. In an
    article or main that holds a quarter of the running text only its own
    blocks can be, and all that aren't ruled out are. The blocks of a table, list or
    preformatted text share their link density. Second pass: see _inherited().
    """
    small, foreign = hinted(found, hints), _foreign(found)
    main = sum(b.words for b, h in zip(found, small) if b.inside and not h and _plain(b))
    around = sum(b.words for b, h in zip(found, small) if not b.inside and not h and _running(b))
    trusted = main > 0 and 3 * main >= around
    chars: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in found:
        if b.group >= 0 and not b.boiler:
            chars[b.group] = chars.get(b.group, 0) + b.chars
            linked[b.group] = linked.get(b.group, 0) + b.linked
    label: list[bool | None] = []
    for b, h in zip(found, small):
        if b.boiler or h or (trusted and not b.inside):
            label.append(False)
            continue
        whole, links = (chars[b.group], linked[b.group]) if b.group >= 0 and b.words < LONG_WORDS else (b.chars, b.linked)
        if links > MOST_LINKS * whole and not (trusted and b.words >= LONG_WORDS):
            label.append(False)
        elif trusted or foreign and _long(b) or b.words >= SHORT_WORDS and b.stops >= FULL_STOP or b.words >= LONG_WORDS and b.stops >= LEAST_STOP:
            label.append(True)
        elif b.words < SHORT_WORDS and b.text[:1] in "©®™":
            label.append(False)
        else:
            label.append(None)
    return _inherited(found, label, [not (b.boiler or h) for b, h in zip(found, small)])


def _inherited(found: list[Block], label: list[bool | None], neighbour: list[bool]) -> list[bool]:
    """Open blocks take the label of the nearest decided block on either side, by blocks between; at equal distance they are left out.

    A heading takes that of the next decided block. Blocks of boilerplate and
    hinted elements are nobody's neighbours. The open blocks of one table, list
    or preformatted text count as one block. A page without any
    decided neighbour keeps its open blocks.
    """
    before: list[tuple[int, bool] | None] = []
    after: list[tuple[int, bool] | None] = [None] * len(label)
    unit: list[int] = []
    last, of = None, {}
    for k, (x, b) in enumerate(zip(label, found)):
        before.append(last)
        unit.append(of.setdefault(b.group, k) if b.group >= 0 and x is None else k)
        if x is not None and neighbour[k]:
            last = (k, x)
    last = None
    ends: dict[int, int] = {}
    for k in range(len(label) - 1, -1, -1):
        after[k] = last
        ends.setdefault(unit[k], k)
        if label[k] is not None and neighbour[k]:
            last = (k, label[k])
    out: list[bool] = []
    for k, x in enumerate(label):
        if x is None:
            first, end = unit[k], ends[unit[k]]
            near = [] if found[k].heading and after[k] else [(first - before[first][0], before[first][1])] if before[first] else []
            near += [(after[end][0] - end, after[end][1])] if after[end] else []
            if not near:
                x = True
            elif len(near) == 2 and near[0][0] == near[1][0]:
                x = near[0][1] and near[1][1]
            else:
                x = min(near)[1]
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: kept blocks in order, joined by one space; empty for null."""
    if not page:
        return ""
    found, hints = blocks(page)
    return " ".join(b.text for b, keep in zip(found, decide(found, hints)) if keep)


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page (page_id, url, html; null html: empty): page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x) for x in batch.column("html").to_pylist()]
            yield table(EXTRACTED, [batch.column("page_id"), batch.column("url"), out, [len(x) for x in out]])

    arrow_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
