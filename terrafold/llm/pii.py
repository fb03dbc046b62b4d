"""Personal data, disguised or not, with offsets into the text as it stands.

The patterns are run on the text itself and, where it holds signs of a
disguise, on a normalised form of it. Each normalising step is a transducer: it
rewrites some stretches and keeps, for each character it puts out, where in the
source that character comes from, so that a span found later can be told in
source offsets.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# -- base patterns ---------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def emails(text: str) -> list[Span]:
    """Leftmost matches; looks outwards from each ``@``, so long runs of letters cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[Span]:
    def fits(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 3 or len(part) == 3 and int(part) <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(fits, m[0].split(".")))]


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(double[int(d)] for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = "".join(_DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]


FINDERS: dict[str, Callable[[str], list[Span]]] = dict(zip(KINDS, (emails, ips, cards, phones)))


def base_spans(text: str) -> dict[str, list[Span]]:
    numbers = _DIGITS.search(text) is not None
    return {k: f(text) if k == "email" or numbers else [] for k, f in FINDERS.items()}


# -- transducers -----------------------------------------------------------


class Mapped:
    """A text with, for each of its characters, the source span behind it."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str | list[tuple[str, Span]] | None]) -> Mapped:
        """Replace matches. None keeps a match, an empty replacement drops it."""
        return self.replace((m.span(), to(m)) for m in pattern.finditer(self.text) if m.end() > m.start())

    def replace(self, pieces: Iterable[tuple[Span, str | list[tuple[str, Span]] | None]]) -> Mapped:
        """Replace ascending spans. What is put out stands for all of the span: its last
        character ends where the span ends; in a list, each string stands for
        its own part. None keeps a span, an empty replacement drops it."""
        parts, starts, ends, at = [], [], [], 0
        for (a, b), new in pieces:
            if new is None:
                continue
            parts.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            for s, (x, y) in [(new, (a, b))] if isinstance(new, str) else new:
                parts.append(s)
                same = len(s) == y - x
                starts += self.starts[x:y] if same else [self.starts[x]] * len(s)
                ends += self.ends[x:y] if same else [self.ends[y - 1]] * len(s)
            at = b
        if not at:
            return self
        return Mapped("".join(parts) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])

    def translate(self, table: dict[str, str]) -> Mapped:
        """Replace single characters by one character or by none."""
        gone = {c for c, new in table.items() if not new}
        text = self.text.translate(str.maketrans(table))
        if len(text) == len(self.text):
            return Mapped(text, self.starts, self.ends)
        kept = [i for i, c in enumerate(self.text) if c not in gone]
        return Mapped(text, [self.starts[i] for i in kept], [self.ends[i] for i in kept])


# Characters that look like the ASCII character before them.
_LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "кκ", "l": "ӏⅼ",
    "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝѡ",
    "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "＠﹫", ".": "。．․｡‧", "-": "‐‑‒–—−﹣",
    "+": "＋﹢➕", " ": "\xa0             　",
}
_HIDDEN = "\xad​‌‍⁠﻿"
_PLAIN = {c: a for a, all_ in _LOOKALIKES.items() for c in all_} | dict.fromkeys(_HIDDEN, "")


def _plain(c: str) -> str | None:
    if c in _PLAIN:
        return _PLAIN[c]
    if 0xFF01 <= ord(c) <= 0xFF5E:  # full-width forms of ASCII
        return chr(ord(c) - 0xFEE0)
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    return None


def _odd(text: str) -> dict[str, str]:
    """The text's characters that look like an ASCII one, or like nothing."""
    if text.isascii():
        return {}
    return {c: new for c in set(text) if c > "\x7f" and (new := _plain(c)) is not None}


# Digit words of the four languages of the corpus, from zero to nine.
_DIGIT_WORDS = (
    "zero oh one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_VALUE: dict[str, str] = {"zwo": "2"}
for _line in _DIGIT_WORDS:
    _VALUE |= {"oh": "0"} | {w: str(i) for i, w in enumerate(_line.replace("oh ", "").split())}
_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_UNIT = rf"(?:(?:double|triple)[ -]+)?(?:{_WORD}|[0-9]+)"
_JOIN = r"(?:[ ]?[,-][ ]?|[ ]++)"
_POINT = r"(?:[ ]++(?:dot|point|punkt|punto)[ ]++|[ ]?\.[ ]?)"
#: Numbers told in words, or partly in words, next to each other or around spoken dots.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus[ ]+)|\+[ ]?)?{_UNIT}(?:(?:{_POINT}|{_JOIN}){_UNIT})+(?!\w)", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?P<plus>plus[ ]+|\+[ ]?)|(?P<times>double|triple)[ -]+|(?P<word>{_WORD})|(?P<number>[0-9]+)|(?P<point>{_POINT})|[ ]++|.", re.IGNORECASE)


def _digits(m: re.Match) -> str | None:
    """The digits of a number with at least four digit words."""
    out, words, times = [], 0, 1
    for p in _SPELLED_PART.finditer(m[0]):
        if p["plus"]:
            out.append("+")
        elif p["times"]:
            times = 2 if p["times"].lower() == "double" else 3
        elif p["word"]:
            out.append(_VALUE[p["word"].lower()] * times)
            words, times = words + 1, 1
        elif p["number"]:
            out.append(p["number"])
        elif p["point"]:
            out.append(".")
    return "".join(out) if words >= 4 else None


def _mixed(m: re.Match) -> list[tuple[str, Span]] | None:
    """The parts of a number with up to three digit words, or spoken dots only; separators that touch no word stay."""
    out: list[tuple[str, Span]] = []
    held: list[tuple[str, Span]] = []
    words, dots, times, word, first = 0, 0, 1, False, None
    for p in _SPELLED_PART.finditer(m[0]):
        a, b = m.start() + p.start(), m.start() + p.end()
        if p["plus"]:
            out.append(("+", (a, b)))
        elif p["times"]:
            times, first = 2 if p["times"].lower() == "double" else 3, a
        elif p["word"] or p["number"]:
            # what stands between a word and its neighbours joins them, but for a full stop
            if any("." in s for s, _ in held) or not (word or p["word"]):
                out += held
            digits = _VALUE[p["word"].lower()] if p["word"] else p["number"]
            out.append((digits * times, (a if first is None else first, b)))
            words, word = words + bool(p["word"]), bool(p["word"])
            times, first, held = 1, None, []
        elif p["point"] and p["point"].strip() != ".":
            out.append((".", (a, b)))
            dots, word = dots + 1, False
        else:
            held.append((p[0], (a, b)))
    return out if words < 4 and (words or dots) else None


_SIGN_AT, _SIGN_DOT = r"at|@|arroba|arobase|ät", r"dot|\.|punkt|punto|point"
_OPEN, _CLOSE = r"[\[({<][ ]*", r"[ ]*[\])}>]"
_BRACKETED_AT = re.compile(rf"{_OPEN}(?:{_SIGN_AT}|a){_CLOSE}", re.IGNORECASE)
_BRACKETED_DOT = re.compile(rf"{_OPEN}(?:{_SIGN_DOT}){_CLOSE}", re.IGNORECASE)


def _bracketed(text: str, sign: re.Pattern, to: str) -> Iterator[tuple[Span, str]]:
    """Signs in brackets, with the spaces around them."""
    free = 0
    for m in sign.finditer(text):
        a, b = _spaces(text, *m.span(), free)
        yield (a, b), to
        free = b


def _spaces(text: str, a: int, b: int, free: int) -> Span:
    """The span with the spaces on both of its sides, none before ``free``."""
    while a > free and text[a - 1] == " ":
        a -= 1
    while b < len(text) and text[b] == " ":
        b += 1
    return a, b


#: The at of an address told in words, wherever one may stand.
_AT = re.compile(r"@|(?<=[ ])(?:at|arroba|arobase|ät)(?=[ ])|(?<=[-_])at(?=[-_])", re.IGNORECASE)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_DOT = r"(?:[ ]++(?:dot|punkt|punto|point)[ ]++|[-_]dot[-_]|\.)"
_LABEL = r"(?:(?!-dot-)[A-Za-z0-9-])++"
_TOLD_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})++", re.IGNORECASE)
_DOT_LABEL = re.compile(rf"(?P<dot>{_DOT})(?P<top>[A-Za-z]{{2,}}+(?![A-Za-z0-9]))?(?:{_LABEL})?", re.IGNORECASE)
_SPOKEN_DOT = re.compile(r"[ ]+(?:dot|punkt|punto|point)[ ]+|[-_]dot[-_]", re.IGNORECASE)


def _told_name(text: str, end: int, free: int) -> int | None:
    """Where the name before an at begins: words joined by full stops or spoken dots, looked at from their end."""
    best, at = None, end
    while True:
        a = at
        while a > free and text[a - 1] in _NAME:
            a -= 1
        if a == at:
            return best
        if a == free or text[a - 1] != ".":
            best = a
        if a > free and text[a - 1] == ".":
            at = a - 1
            continue
        b = a
        while b > free and text[b - 1] == " ":
            b -= 1
        word = next((w for w in _DOT_WORDS if b < a and text[max(free, b - len(w)) : b].lower() == w), None)
        if word is None:
            return best
        at = b - len(word)
        if at == free or text[at - 1] != " ":
            return best
        while at > free and text[at - 1] == " ":
            at -= 1


def _told_domain(text: str, start: int) -> tuple[int, str] | None:
    """Where the domain after an at ends, and its last dot; that of the longest one that ends in letters."""
    m = _TOLD_DOMAIN.match(text, start)
    if not m:
        return None
    first = re.compile(_LABEL, re.IGNORECASE).match(text, start)
    ends = [(p.end("top"), p["dot"]) for p in _DOT_LABEL.finditer(text, first.end(), m.end()) if p["top"]]
    return ends[-1] if ends else None


def _addresses(text: str) -> Iterator[tuple[Span, str]]:
    """Addresses told in words; looks outwards from each at, and no further than the address before it.

    An at in words needs a spoken dot before the last part: "look at example.com" is prose.
    """
    free = 0
    for m in _AT.finditer(text):
        if m.start() < free:
            continue
        sign, beside = m[0] == "@", text[m.start() - 1 : m.start()]
        a, b = (m.start() - 1, m.end() + 1) if not sign and beside in "-_" else _spaces(text, *m.span(), free)
        domain = _told_domain(text, b)
        if domain is None or not sign and domain[1] == ".":
            continue
        name = _told_name(text, a, free)
        if name is None:
            continue
        end = domain[0]
        yield (name, end), _SPOKEN_DOT.sub(".", text[name:a]) + "@" + _SPOKEN_DOT.sub(".", text[b:end])
        free = end


#: Signs of a disguise; a text without any is its own normal form.
_BRACKETS = re.compile(rf"[\[({{<][ ]*(?:{_SIGN_AT}|{_SIGN_DOT}|a)[ ]*[\])}}>]", re.IGNORECASE)
_SPOKEN_SIGNS = (" dot ", "-dot-", "_dot_", " punkt ", " punto ", " point ", " @", "@ ")
_BETWEEN = str.maketrans(dict.fromkeys("-,.+()[]{}<>:;!?\"'/*", " "))
_DIGIT = re.compile(r"\d")


def _hint(text: str) -> bool:
    low = text.lower()
    if any(s in low for s in _SPOKEN_SIGNS) or _BRACKETS.search(text):
        return True
    words = sum(map(_VALUE.__contains__, low.translate(_BETWEEN).split()))
    return words >= 4 or words > 0 and _DIGIT.search(low) is not None


def normal_forms(text: str) -> list[Mapped]:
    """The text without homoglyphs, spelled digits and at/dot disguises, and then, if it has any,
    with its numbers of mixed spelling; none if it has no disguise.

    They are two forms since a digit word may also just stand beside a number.
    """
    odd = _odd(text)
    if not odd and not _hint(text):
        return []
    out = Mapped(text)
    if odd:
        out = out.translate(odd)
    for sign, to in ((_BRACKETED_AT, "@"), (_BRACKETED_DOT, ".")):
        out = out.replace(_bracketed(out.text, sign, to))
    mixed = out.rewrite(_SPELLED, _mixed)
    told = out.rewrite(_SPELLED, _digits)
    return [told.replace(_addresses(told.text)), *([] if mixed is out else [mixed])]


class Taken:
    """Stretches of the text that spans of a kind cover, ascending and apart."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def add(self, a: int, b: int, beyond: bool) -> bool:
        """Take (a, b) if it touches none, or, with ``beyond``, holds each one that it touches and is none of them."""
        lo, hi = bisect.bisect_right(self.ends, a), bisect.bisect_left(self.starts, b)
        if lo < hi and not (beyond and a <= self.starts[lo] and self.ends[hi - 1] <= b and (a, b) != (self.starts[lo], self.ends[lo])):
            return False
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]
        return True


def find(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) of every span, by start and then kind as listed.

    Spans of the normal forms come in source offsets and are added where they
    touch no base span of their kind, or reach beyond the base spans they touch;
    those of mixed spelling only where they touch none. Time grows with the
    text's length, whatever it holds.
    """
    base = base_spans(text)
    found = [(a, b, k, True) for k in KINDS for a, b in base[k]]
    taken = {k: Taken(base[k]) for k in KINDS}
    for mixed, form in enumerate(normal_forms(text)):
        for k, spans in base_spans(form.text).items():
            for span in spans:
                a, b = form.source(span)
                if taken[k].add(a, b, not mixed):
                    found.append((a, b, k, False))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType()).add("base", T.BooleanType())
)


@F.pandas_udf(SPANS)
def pii_spans(texts: pd.Series) -> pd.Series:
    """Spans of personal data in each text; none in an empty or null one."""
    return pd.Series([[{"kind": k, "start": a, "end": b, "base": x} for a, b, k, x in find(t or "")] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series) -> pd.Series:
    """Each text with its spans replaced by their kind, such as ``<EMAIL>``; null stays null.

    Where spans of two kinds overlap, they are replaced together, under the first one's name.
    """

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        parts, at = [], 0
        for a, b, kind, _ in find(text):
            if a >= at:
                parts += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join(parts) + text[at:] if parts else text

    return pd.Series([mask(t) for t in texts], dtype=object)
