"""Personal data: e-mail addresses, IP addresses, payment cards and phone numbers.

Method: candidate gradient boosting. Strict patterns give the base spans, which
always stay. High-recall generators propose further, overlapping spans; boosted
trees score them by format and context, and thresholds calibrated for precision
on documents that the trees didn't see select the spans to add. The trees learn
from made-up data in forms that the strict patterns don't know, and from
look-alikes, both put into texts of the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import arrow_batches, documents, table

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents (on average), items put into each, and candidates.
SAMPLE_DOCS = 2_500
PLANTED = 6
#: Candidates of a sampled text's own, at most, that training takes.
OWN = 200
SAMPLE_CANDIDATES = 40_000
#: Precision that a threshold must reach on held-out documents, and the least threshold.
PRECISION = 0.99
LEAST = 0.7
#: Characters of context on either side.
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CLUSTER = re.compile(r"[+0-9][0-9\x20.()/-]*")
# A leftmost match starts where its run of digits does, so later starts in a run needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OBFUSCATED = re.compile(r"[\w.%+-]{1,64}(?:\s?(?:@|\[at\]|\(at\)|\{at\})\s?|\sat\s(?=[\w-]{1,63}\sdot\s))[\w-]{1,63}(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\sdot\s)[\w-]{1,63}){1,8}", re.IGNORECASE)
_JOINED = re.compile(r"(?<![A-Za-z0-9.%+])[A-Za-z0-9.%+]{1,64}([_-])at\1[A-Za-z0-9]{1,63}(?:\1dot\1[A-Za-z0-9]{1,63}){1,4}", re.IGNORECASE)
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:[\[({](?:\.|dot)[\])}]|\bdot\b)\s?[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_SPACED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
# Groups of digits with one separator throughout, whichever it is.
_EVEN = re.compile(r"(?<![0-9])[0-9]{1,6}(\x20?[/.-]\x20?|\x20{1,3})[0-9]{2,7}(?:\1[0-9]{2,7}){0,5}(?![0-9])")
_AT = re.compile(r"@|[\[({]at[\])}]|\sat\s[\w-]{1,63}\sdot\s|([_-])at\1", re.IGNORECASE)
# Forms to learn, by kind; # is a digit, x a hexadecimal one, N the part of an address before its @ and H a host's name, P either of letters only, T a common last label.
FORMS = {
    "email": ("N [at] H [dot] T", "N(at)H(dot)T", "N {at} H.T", "N [at] H.example.T", "N at H dot T", "N at H dot co dot T", "N @ H.T", "N[at]H[dot]example[dot]T", "N (at) H (dot) T", "P_at_P_dot_T", "P-at-P-dot-T"),
    "ip": ("#[.]#[.]#[.]#", "#(.)#(.)#(.)#", "#[dot]#[dot]#[dot]#", "xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx", "xxxx:xxx::xxxx:xxxx:x", "fe80::xxxx:xxxx:xxxx:xxxx", "2001:db8::xxxx:xx", "# . # . # . #", "# dot # dot # dot #"),
    "card": ("####.####.####.####", "####  ####  ####  ####", "#### - #### - #### - ####", "####.######.#####", "####  ######  #####", "####/####/####/####", "#### / ###### / #####"),
    "phone": ("0#### ######", "(0##) ####-####", "(0##) ########", "00## ## ########", "0049 ### #######", "(###) ###-####", "###-###-####", "###.###.####", "0## ### ####", "0### ## ## ##", "0# ## ## ## ##", "1 ### ### ####", "1-###-###-####", "0###-#######", "0###########", "+## (0)## / ######", "+##/###/#######", "0##/#######", "0#-##-##-##-##", "0### ### ###", "0#### ## ## ##", "(0####) ######", "(0#) #### ####", "0##########", "0#########", "00## # ## ## ## ##", "00## # #### ####", "00## ## ### ## ##", "00##-###-#######"),
}
# Forms that look alike but are none; L is a card number that fails its check digit, W a word of the text around.
LOOKALIKES = {
    "email": ("@N", "# @ #.##", "N@", "N @ ##.##", "N.N [at", "N @N", "at H.T", "N (at) home", "[at] the end", "W at W dot W", "W at W dot W", "W at W dot it", "W_at_W"),
    "ip": ("#.#.999.#", "##:##:##", "xx:xx:xx:xx:xx:xx", "##:##:##:##", "300.#.#.#.#", "#[#]#[#]#", "xx-xx-xx-xx", "1:2:3:4:5", "999 . # . # . #", "# . # . #", "#. #. #. 2###"),
    "card": ("L", "L", "#### #### ####", "978-#-##-######-#", "####-####", "############", "##.####.####.##", "20##/20##/20##", "##/##/20##"),
    "phone": ("L", "20##-0#-1# 1# 0#", "1#.0#.20##", "20##-0#-1#", "19##-20## ##", "#.###.###", "# ### ### ###", "##.#### ##.####", "17########", "########", "20########", "0.#### 0.####", "978-#-##-######-#", "978#########", "#### - ####", "##-##-##-##", "1#### 1#### 1####", "0000 0000", "##/##/20##", "#/##/20##", "20##/20## ####", "1#/2# / 3#/4#", "0#########", "0##########", "0###########"),
}
#: What written-out signs stand for.
_MARKED = [(re.compile(r"\s?(?:\[at\]|\(at\)|\{at\})\s?", re.IGNORECASE), "@"), (re.compile(r"\s?(?:\[dot\]|\(dot\)|\{dot\})\s?", re.IGNORECASE), ".")]
_SPOKEN = [*_MARKED, (re.compile(r"(?:\s|([_-]))at(?:\s|\1)", re.IGNORECASE), "@"), (re.compile(r"(?:\s|([_-]))dot(?:\s|\1)", re.IGNORECASE), "."), (re.compile(r"\s?@\s?"), "@")]
_NUMERIC = re.compile(r"\s?(?:[\[({](?:\.|dot)[\])}]|\bdot\b|\.)\s?", re.IGNORECASE)
# Common last labels of host names; the second list's are of countries, the third's of countries and words too.
_GENERIC = frozenset("com org net edu gov mil int info biz name pro io ai app dev cloud online site shop tech".split())
_COUNTRY = frozenset("uk de fr es nl pl ru cn jp br au ca ch se dk fi ie pt cz gr hu ro tr ua kr mx ar cl co za nz eu".split())
_TOPS = (*sorted(_GENERIC), *sorted(_COUNTRY), "it", "in", "us", "at", "be", "no")
_CUES = ("no", "order", "total", "page", "item", "version", "ref", "see", "on", "")
_HINTS = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte", "pay"),
    "phone": ("phone", "tel", "call", "mobil", "fax", "ruf", "llam", "appel"),
}


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        free = m.end() if m else at + 1
        if m:
            found.append(Span(start, 0, free))
        at = text.find("@", free)
    return found


def clusters(text: str) -> list[tuple[int, int]]:
    """Runs of digits, spaces, dots, dashes and brackets, with a plus sign in front at most: every number lies in one."""
    return [m.span() for m in _CLUSTER.finditer(text) if m.end() - m.start() >= 7]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """The strict patterns' spans, leftmost and non-overlapping within a kind, in order of start and kind."""
    found = _emails(text)
    for a, b in clusters(text) if runs is None else runs:
        for m in _IP.finditer(text, a, b):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append(Span(m.start(), 1, m.end()))
        for m in _CARD.finditer(text, a, b):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(Span(m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Overlapping spans of high recall.

    Every number of 7 to 19 digits as card and phone, dotted, spaced, bracketed
    and colon-separated groups as IP address, and written-out e-mail addresses.
    """
    found = set()
    if _AT.search(text):
        found.update(Span(m.start(), 0, m.end()) for pattern in (_OBFUSCATED, _JOINED) for m in pattern.finditer(text))
    if ":" in text:
        found.update(Span(m.start(), 1, m.end()) for m in _COLONS.finditer(text))
    for a, b in runs:
        while b > a and not "0" <= text[b - 1] <= "9":
            b -= 1
        parts = {(m.start(), m.end()) for m in _CARD.finditer(text, a, b)} | {(m.start(), m.end()) for m in _PHONE.finditer(text, a, b)}
        parts.update((m.start(), m.end()) for m in _EVEN.finditer(text, a, b))
        if b - a <= 64:
            parts.add((a, b))
            if a and text[a - 1] == "(":
                parts.add((a - 1, b))
        for s, e in parts:
            if e - s <= 64 and 7 <= len(_digits(text[s:e])) <= 19:
                found.update((Span(s, 2, e), Span(s, 3, e)))
        found.update(Span(m.start(), 1, m.end()) for pattern in (_IP, _SPACED) for m in pattern.finditer(text, a, b) if m.end() - m.start() <= 32)
    if "[.]" in text or "(.)" in text or "{.}" in text or "dot" in text or "DOT" in text:
        found.update(Span(m.start(), 1, m.end()) for m in _DEFANGED.finditer(text))
    return sorted(found)


class Taken:
    """Text that spans cover, as merged stretches in order; asking costs a binary search."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s in sorted(spans):
            if self.ends and s.start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start)
                self.ends.append(s.end)

    def meets(self, span: Span) -> bool:
        """Whether a stretch shares a character with the span."""
        k = bisect.bisect_left(self.starts, span.end)
        return k > 0 and self.ends[k - 1] > span.start

    def add(self, span: Span) -> None:
        """Cover a span that meets no stretch."""
        k = bisect.bisect_left(self.starts, span.start)
        self.starts.insert(k, span.start)
        self.ends.insert(k, span.end)


def address_of(inner: str) -> bool:
    """Whether an IP address is left when bracketed, spaced and written-out dots are put back."""
    plain = inner if ":" in inner else _NUMERIC.sub(".", inner)
    if ":" not in plain:
        plain = ".".join(p.lstrip("0") or "0" for p in plain.split("."))
    try:
        ipaddress.ip_address(plain)
    except ValueError:
        return False
    return True


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate.

    Formats are told by what they come to, not by their signs, so that forms
    which weren't learned are alike to those which were: whether an address is
    left when signs are put back, whether the check digit holds, how the digits
    are grouped, and whether one separator serves throughout. The digits of an
    e-mail address say nothing.
    """
    inner, kind = text[span.start : span.end], KINDS[span.kind]
    before, after = text[max(0, span.start - CONTEXT) : span.start], text[span.end : span.end + CONTEXT]
    digits = "" if kind == "email" else _digits(inner)
    groups = [g for g in re.split("[^0-9]+", inner) if g and digits]
    between = re.findall("(?<=[0-9])[^0-9]+(?=[0-9])", inner) if digits else []
    sizes = [len(g) for g in groups] or [0]
    low = before.lower()
    hexes = [g for g in re.split("[^0-9A-Fa-f]+", inner) if g] if ":" in inner else []
    plain = inner
    for pattern, sign in _SPOKEN if kind == "email" else ():
        plain = pattern.sub(sign, plain)
    labels = plain.rsplit("@", 1)[-1].lower().split(".") if kind == "email" else []
    return [
        *(float(kind == k) for k in KINDS), float(len(digits)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(sizes[-1]), float(len(set(sizes[:-1])) <= 1),
        float(len(set(between))), float(max(map(len, between), default=0)), float("(" in inner or ")" in inner), float(inner.startswith("+")),
        float(kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)), float(len(digits) == 13 and digits[:3] in ("978", "979")),
        float(digits.startswith("0")), float(digits.startswith("00")), float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)), float(inner[:2] in ("19", "20")), float(len(set(digits))),
        float(kind == "ip" and address_of(inner)), float(len(hexes)), float("::" in inner), float(max(map(len, hexes), default=0)),
        float(kind == "email" and _emails(plain) == [Span(0, 0, len(plain))]), float(labels[-1:] != [] and labels[-1] in _GENERIC), float(labels[-1:] != [] and labels[-1] in _COUNTRY),
        float(kind == "email" and (" at " in inner.lower() or " dot " in inner.lower())), float(kind == "email" and ("@" in inner or "[" in inner or "(" in inner or "{" in inner)), float(len(labels)),
        float(inner[:1].isalpha()), float(inner[-1:].isalpha()),
        float(bool(before) and (before[-1].isalnum() or before[-1] in "=\"'_#/@")), float(bool(after) and (after[0].isalnum() or after[0] in "\"'_%@/")),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(any(h in low for h in _HINTS[kind])),
    ]


N_FEATURES = len(features("", Span(0, 0, 0)))


def _check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits + d))


def made(form: str, kind: int, rng: random.Random, words: tuple[str, ...] = ("home",)) -> str:
    """An item in a form; digits of a card form end in their check digit."""
    def name(sign: str) -> str:
        letters = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
        return letters + rng.choice(("", sign + letters[:2], str(rng.randint(0, 9)), str(rng.randint(1, 999))))

    if form == "L":
        head = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
        whole = head + rng.choice([d for d in "0123456789" if d != _check_digit(head)])
        return rng.choice(("", " ", "-", ".", "  ")).join(whole[k : k + 4] for k in range(0, 16, 4))
    out = []
    for c in form:
        if c == "N":
            out.append(name(rng.choice("._")))
        elif c == "H":
            out.append(name("-"))
        elif c == "P":
            out.append(re.sub("[^a-z]", "", name("")))
        elif c == "T":
            out.append(rng.choice(_TOPS))
        elif c == "W":
            out.append(rng.choice(words))
        elif c == "x":
            out.append(rng.choice("0123456789abcdef"))
        elif c == "#":
            out.append(str(rng.randint(0, 255)) if kind == 1 and ":" not in form else rng.choice("0123456789"))
        else:
            out.append(c)
    item = "".join(out)
    if kind == 2 and form in FORMS["card"]:
        item = item[:-1]
        item += _check_digit(_digits(item))
    return item


def _shape(inner: str) -> str:
    return re.sub("[A-Za-z_]+", "a", re.sub("[0-9]", "#", inner))


_SHAPES = frozenset(_shape(f) for k in ("card", "phone") for f in FORMS[k])


def planted(text: str, form: str, kind: int, rng: random.Random) -> tuple[str, int, int]:
    """A stretch of the text with an item in it, after a cue in half the cases (a look-alike's may be a true item's; digits alone are an item only after one), and the item's place."""
    at = text.find(" ", rng.randint(0, max(0, len(text) - 1)))
    at = len(text) if at < 0 else at
    words = tuple(w for w in text[max(0, at - 200) : at + 200].split() if w.isalpha() and len(w) < 20) or ("home",)
    item = made(form, kind, rng, words)
    true = form in FORMS[KINDS[kind]]
    bare = not form.strip("0#")
    hinted = true or rng.random() < 0.3 and not bare
    cue = rng.choice(_HINTS[KINDS[kind]][:-1] if hinted else _CUES) + rng.choice((" ", ": ", ". ")) if rng.random() < 0.5 or true and bare else ""
    left = f"{text[max(0, at - 2 * CONTEXT) : at]} {cue}"
    return f"{left}{item}{rng.choice((' ', ' ', ', ', '. ', ')'))}{text[at + 1 : at + 2 * CONTEXT]}", len(left), len(left) + len(item)


def labelled(text: str) -> list[tuple[list[float], bool, str]]:
    """(features, label, form put in, if any) of candidates that the strict patterns don't settle.

    PLANTED items in forms to learn or look-alikes are put into the text, alone
    each; a candidate that is a whole item of its kind is positive, any other
    that meets the item is negative. The text's own candidates are negative,
    but for numbers in a form to learn and addresses that it writes out: these
    may be personal data, and are left out.
    """
    rng, rows = random.Random(zlib.crc32(text.encode())), []
    for k in range(PLANTED):
        kind, true = rng.randrange(len(KINDS)), k % 2 == 0
        form = rng.choice((FORMS if true else LOOKALIKES)[KINDS[kind]])
        whole, start, end = planted(text, form, kind, rng)
        runs = clusters(whole)
        strict = Taken(base_spans(whole, runs))
        for span in candidates(whole, runs):
            hit = true and span == (start, kind, end)
            if span.start < end and start < span.end and not strict.meets(span) and (hit or span.kind or not written_out(whole[span.start : span.end])):
                rows.append((features(whole, span), hit, form))
    runs = clusters(text)
    strict = Taken(base_spans(text, runs))
    for span in candidates(text, runs)[:OWN]:
        inner = text[span.start : span.end]
        if not strict.meets(span) and (_shape(inner) not in _SHAPES if span.kind > 1 else ":" not in inner and "[" not in inner) and not (span.kind == 0 and written_out(inner)):
            rows.append((features(text, span), False, ""))
    return rows


def written_out(inner: str) -> bool:
    """Whether a strict address is left when bracketed words are put back."""
    plain = inner
    for pattern, sign in _MARKED:
        plain = pattern.sub(sign, plain)
    return plain != inner and _emails(plain) == [Span(0, 0, len(plain))]


class Sample(NamedTuple):
    """Candidates drawn for training: features, labels, forms of what was put in, and which are of held-out documents."""

    x: np.ndarray
    y: np.ndarray
    forms: np.ndarray
    held: np.ndarray


class Learned(NamedTuple):
    """Trees, thresholds by kind, and what the thresholds reach on held-out documents: (precision, recall) by kind."""

    model: tuple
    thresholds: list[float]
    reached: list[tuple[float, float]]


def draw(docs: DataFrame) -> Sample:
    """Candidates of a bounded sample of distinct texts; a fifth of the documents, by hash, is held out."""
    arrow_batches(docs.sparkSession)
    n = max(1, docs.count())
    share = min(1_000_000, math.ceil(1_000_000 * SAMPLE_DOCS / n))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*r, hashlib.md5(text.encode()).hexdigest()) for text in batch.column(0).to_pylist() for r in labelled(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.float64())), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.bool_()), (2, pa.string()), (3, pa.string())))], ["x", "y", "form", "at"]
            )

    sample = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)).select("text").distinct()
    drawn = sorted(sample.mapInArrow(propose, "x array<double>, y boolean, form string, at string").orderBy("at", "x").limit(SAMPLE_CANDIDATES).collect(), key=lambda r: (r["at"], r["x"]))
    return Sample(
        np.array([r["x"] for r in drawn], float).reshape(-1, N_FEATURES), np.array([r["y"] for r in drawn], float),
        np.array([r["form"] for r in drawn], str), np.array([int(r["at"][:8], 16) % 5 == 0 for r in drawn], bool),
    )


def fitted(sample: Sample) -> Learned:
    """Trees of the documents that aren't held out, and thresholds of those that are.

    A kind's threshold is the least from LEAST on whose precision on the
    held-out documents reaches PRECISION, and above 1 (nothing is added) where
    none does.
    """
    x, y, _, held = sample
    model = boosting.fit(x[~held], y[~held], rounds=60, depth=4)
    scores = boosting.chance(model, x[held]) if held.any() else np.empty(0)
    thresholds, reached = [], []
    for k in range(len(KINDS)):
        own = x[held][:, k] > 0 if held.any() else np.empty(0, bool)
        true = y[held] > 0
        tried = [t for t in np.arange(LEAST, 1.0, 0.005) if (hit := own & (scores >= t)).any() and true[hit].mean() >= PRECISION]
        thresholds.append(float(tried[0]) if tried else 2.0)
        hit = own & (scores >= thresholds[-1])
        reached.append((float(true[hit].mean()) if hit.any() else 1.0, float((hit & true).sum() / max(1, (own & true).sum()))))
    return Learned(model, thresholds, reached)


def without_form(sample: Sample, form: str) -> tuple[float, float]:
    """Precision of a form's kind and recall of the form when no item of the form is learned or calibrates.

    Nothing that was put in in the form is learned, whether it is an item or a
    look-alike. All the sample's items of the form are looked for, and the
    held-out documents' other candidates tell the precision.
    """
    x, y, forms, held = sample
    rest = forms != form
    model, thresholds, _ = fitted(Sample(x[rest], y[rest], forms[rest], held[rest]))
    kind = next(k for k, name in enumerate(KINDS) if form in FORMS[name])
    own = ~rest & (y > 0)
    hit = (own | held) & (x[:, kind] > 0) & (boosting.chance(model, x) >= thresholds[kind])
    return float(y[hit].mean()) if hit.any() else 1.0, float(hit[own].sum() / max(1, own.sum()))


def train(docs: DataFrame) -> Learned:
    """Trees and thresholds from a bounded sample of distinct texts."""
    return fitted(draw(docs))


def select(text: str, strict: list[Span], runs: list[tuple[int, int]], model: tuple, thresholds: list[float]) -> list[Span]:
    """Strict spans plus the best scored of the other candidates that overlap no selected span."""
    covered = Taken(strict)
    proposed = [s for s in candidates(text, runs) if thresholds[s.kind] <= 1 and not covered.meets(s)]
    if not proposed:
        return strict
    scores = boosting.chance(model, np.array([features(text, s) for s in proposed], float))
    taken = list(strict)
    for score, span in sorted(zip((-scores).tolist(), proposed)):
        if -score >= thresholds[span.kind] and not covered.meets(span):
            taken.append(span)
            covered.add(span)
    return sorted(taken)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame) -> DataFrame:
    """Personal data in each whole text (doc_id, text; null: empty).

    n_email, n_ip, n_card, n_phone and base_sha256 are of the strict spans;
    ``spans`` lists these and the added ones as kind:start:end, in characters.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, thresholds, _ = learned.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                runs = clusters(text)
                strict = base_spans(text, runs)
                spans = select(text, strict, runs, model, thresholds)
                rows.append((*(sum(s.kind == k for s in strict) for k in range(len(KINDS))), hashlib.sha256(listed(strict).encode()).hexdigest(), listed(spans)))
            yield table(FOUND, [batch.column("doc_id"), *(zip(*rows) if rows else [[]] * 6)])

    return docs.mapInArrow(run, ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"]))


def redact(docs: DataFrame) -> DataFrame:
    """The documents' rows with the found spans of ``text`` replaced by their kind in brackets; null texts stay null."""
    arrow_batches(docs.sparkSession)
    learned = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, thresholds, _ = learned.value
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    runs = clusters(text)
                    parts, end = [], 0
                    for s in select(text, base_spans(text, runs), runs, model, thresholds):
                        if s.start >= end:
                            parts += text[end : s.start], f"[{KINDS[s.kind].upper()}]"
                        end = max(end, s.end)
                    text = "".join([*parts, text[end:]])
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
