"""Personal data under disguise: offset-preserving deobfuscation.

The base patterns run on the text as it is. Where a text shows signs of disguise, a chain of transducers rewrites it:
look-alike and invisible characters, then spelled digits, then at/dot disguises. Each keeps, for every character it
puts out, the span of source characters it stands for. The same patterns run on the rewritten text; what they find
across a rewritten place is mapped back to source characters and added.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .spans import Span, scan_rows

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")  # a run of digits is tried once, however long
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.tld, found from each @ outwards, so long words cost no more than short ones."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers of at most 255; longer dotted chains are taken four by four, as leftmost matches are."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    """Digit runs with single spaces or hyphens, of 12 to 19 digits passing the check sum."""
    out = []
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    """International numbers of 9 to 15 digits."""
    out = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(m.span())
    return out


_FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> list[Span]:
    """The fixed patterns on the text as it is."""
    return [(k, s, e) for k, f in _FINDERS.items() for s, e in f(text)]


# Letters of other scripts drawn like ASCII letters (fixed values).
_ALIKE = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈаеорсухѕіјѵһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρικυχıօոսց",
        "ABEKMHOPCTYXSIJaeopcyxsijvhdqwABEZHIKMNOPTYXaovpikuxionug",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠⁡⁢⁣﻿͏"
# Spelled digits in the four languages of the corpus (fixed values).
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_ONE = rf"(?:{_WORD}|[0-9]+)"
_RUN = re.compile(rf"(?<!\w)(?:(?:plus\s?|\+)\s?)?{_ONE}(?:[\s,.()-]{{1,3}}{_ONE}){{3,}}(?!\w)", re.I)
_SPELLED_HINT = re.compile(rf"\b{_WORD}[\s,.()-]{{1,3}}{_ONE}[\s,.()-]{{1,3}}{_ONE}\b", re.I)
_TOKEN = re.compile(rf"plus|{_WORD}", re.I)
_AT_WORD, _DOT_WORD = r"(?:at|ät|arroba|arobase)", r"(?:dot|punkt|punto|point)"
_BRACKET_AT = re.compile(rf"\s?[\[({{<]\s?(?:@|{_AT_WORD})\s?[\])}}>]\s?", re.I)
_BRACKET_DOT = re.compile(rf"\s?[\[({{<]\s?(?:\.|{_DOT_WORD})\s?[\])}}>]\s?", re.I)
#: Stands in for a dot rewritten from a bracketed form while _spoken seeks it; a lone surrogate, so in no valid text.
_MARK = "\udc2e"
_SPOKEN_AT = re.compile(rf"\s?@\s?|\s{_AT_WORD}\s", re.I)
_SPOKEN_DOT = re.compile(rf"\s{_DOT_WORD}\s", re.I)
_DOT_BEFORE = re.compile(rf"\s{_DOT_WORD}\s$", re.I)
#: The host's own dots may be real, one must be spelled or bracketed.
_SPOKEN_HOST = re.compile(rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:(?:{_MARK}|\s{_DOT_WORD}\s)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)+", re.I)
# Endings of hosts that a plain "at" with plain spelled dots must have (fixed values); without a mark, other words are prose.
_ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro app dev xyz online site shop store blog cloud tech email web mail example test invalid localhost local "
    "ai au be br ca ch cn co cz de dk es eu fi fr gr hu ie io jp kr mx nl no nz pl pt ro ru se sk tr tv ua uk us za".split()
)
_IN_LABEL = _LOCAL - {"."}
_SPOKEN_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\.|\s?{_DOT_WORD}\s?)[0-9]{{1,3}}){{3}}(?![\w])", re.I)
_OCTET = rf"{_ONE}(?:[\s-]{_ONE}){{0,2}}"
_SPELLED_IP = re.compile(rf"(?<![\w.]){_OCTET}(?:\s{_DOT_WORD}\s{_OCTET}){{3}}(?!\w)", re.I)
_ANY_DOT = re.compile(rf"\s?{_DOT_WORD}\s?", re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s?(?:@|\.|{_AT_WORD}|{_DOT_WORD})\s?[\])}}>]", re.I)
#: ASCII letters in lower case, other ASCII as space, bytes of other characters as they are.
_LETTERS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
_SPELLED_WORDS = {w.encode() for w in _SPELLED}
_DOT_WORDS = {b"dot", b"punkt", b"punto", b"point"}


def _disguised(text: str) -> bool:
    """Whether any transducer but the first could have something to rewrite."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    if not words.isdisjoint(_DOT_WORDS):
        return True
    if ("(" in text or "[" in text or "{" in text or "<" in text) and _BRACKETED.search(text):
        return True
    return not words.isdisjoint(_SPELLED_WORDS) and bool(_SPELLED_HINT.search(text))


@cache
def _plain(c: str) -> str | None:
    """What a character is drawn as in ASCII: a letter, digit or mark; empty if invisible; None if it stays."""
    if c in _INVISIBLE:
        return ""
    if c in _ALIKE:
        return _ALIKE[c]
    flat = unicodedata.normalize("NFKC", c)
    if len(flat) == 1 and "!" <= flat <= "~" and flat != c:
        return flat
    d = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
    return None if d is None else str(d)


@cache
def _odd() -> re.Pattern:
    """All characters that _plain rewrites, by rule over the Basic Multilingual Plane and the styled letters."""
    codes = [c for c in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)) if _plain(chr(c)) is not None and chr(c) not in "ªº²³¹"]
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"{chr(codes[i])}-{chr(codes[j])}")
        i = j + 1
    return re.compile("[" + "".join(out) + "]")


class Traced:
    """A rewritten text with, for each of its characters, the source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, not overlapping) of the present text."""
        for _, e, new in edits:
            if not new and e < len(self.text):
                self.changed[e] = True  # something vanished before it
        text, starts, ends, changed, at = [], [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += [self.start[at:s], np.full(len(new), self.start[s])]
            ends += [self.end[at:s], np.full(len(new), self.end[e - 1])]
            changed += [self.changed[at:s], np.ones(len(new), bool)]
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])
        self.changed = np.concatenate([*changed, self.changed[at:]])

    def source(self, s: int, e: int) -> tuple[int, int]:
        return int(self.start[s]), int(self.end[e - 1])


def _unmask_characters(t: Traced) -> None:
    edits = []
    for m in _odd().finditer(t.text):
        edits.append((m.start(), m.end(), _plain(m.group()) or ""))
    if edits:
        t.rewrite(edits)


def _unmask_digits(t: Traced) -> list[tuple[int, int]]:
    """Rewrites runs of four or more spelled digits; spans (in the new text) of runs long enough for a telephone."""
    edits, runs, shift = [], [], 0
    for m in _RUN.finditer(t.text):
        words = [w for w in _TOKEN.finditer(t.text, m.start(), m.end())]
        if sum(w.group().lower() != "plus" for w in words) < 3:
            continue
        flat = re.sub(r"[\s,.()-]+", "", _TOKEN.sub(lambda w: "+" if w.group().lower() == "plus" else _SPELLED[w.group().lower()], m.group()))
        edits.append((m.start(), m.end(), flat))
        runs.append((m.start() + shift, m.start() + shift + len(flat)))
        shift += len(flat) - (m.end() - m.start())
    if edits:
        t.rewrite(edits)
    return runs


def _unmask_octets(t: Traced) -> None:
    """Rewrites four groups of at most three spelled digits with spelled dots between them."""
    edits = []
    for m in _SPELLED_IP.finditer(t.text):
        parts = [re.sub(r"[\s-]+", "", _TOKEN.sub(lambda w: _SPELLED.get(w.group().lower(), w.group()), part)) for part in _SPOKEN_DOT.split(m.group())]
        if any(w.group().lower() in _SPELLED for w in _TOKEN.finditer(m.group())) and all(len(x) <= 3 for x in parts):
            edits.append((m.start(), m.end(), ".".join(parts)))
    if edits:
        t.rewrite(edits)


def _spoken_local(text: str, end: int, floor: int) -> int:
    """Where the local part that ends at `end` starts: labels joined by real, bracketed or spelled dots, however many."""
    start = end
    while start > floor and text[start - 1] in _IN_LABEL:
        start -= 1
    while end > start > floor:
        m = _DOT_BEFORE.search(text, max(floor, start - 9), start)
        joint = start - 1 if text[start - 1] in (".", _MARK) else m.start() if m else start
        before = joint
        while before > floor and text[before - 1] in _IN_LABEL:
            before -= 1
        if before == joint:
            break
        start = before
    return start


def _spoken(text: str) -> list[tuple[int, int, int, int]]:
    """(start, at's start, at's end, end) of addresses whose at or dots are words: name at host dot tld."""
    out, done = [], 0
    for at in _SPOKEN_AT.finditer(text):
        if at.start() < done:
            continue
        host = _SPOKEN_HOST.match(text, at.end())
        if host and "@" not in at.group() and not any(c in host.group() for c in (".", _MARK)) and host.group().rsplit(None, 1)[-1].lower() not in _ENDINGS:
            continue
        start = _spoken_local(text, at.start(), done) if host else at.start()
        if start < at.start():
            out.append((start, at.start(), at.end(), host.end()))
            done = host.end()
    return out


def _unmask_at_dot(t: Traced) -> None:
    spoken = ""
    for pattern, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        edits = [(m.start(), m.end(), new) for m in pattern.finditer(t.text)]
        if edits:
            spoken = pattern.sub(_MARK, t.text) if new == "." else ""  # as long as the rewritten text
            t.rewrite(edits)
    edits, taken = [], []
    for start, s, e, end in _spoken(spoken or t.text):
        edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(t.text, start, s)]
        edits += [(s, e, "@")] if t.text[s:e] != "@" else []
        edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(t.text, e, end)]
        taken.append((start, end))
    k = 0
    for m in _SPOKEN_IP.finditer(t.text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            edits += [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(t.text, *m.span())]
    if edits:
        t.rewrite(sorted(edits))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of one text, in code points, end exclusive."""
    base = base_spans(text)
    odd = not text.isascii() and _odd().search(text)
    if not odd and not _disguised(text):
        return base, []
    t = Traced(text)
    if odd:
        _unmask_characters(t)
    found: set[Span] = set()
    _unmask_octets(t)
    for s, e in _unmask_digits(t):
        number = t.text[s:e].lstrip("+")
        if 9 <= len(number) <= 15 and not (len(number) >= 12 and luhn(number)):  # such are cards
            found.add(("phone", *t.source(s, e)))
    _unmask_at_dot(t)
    before = np.concatenate([[0], np.cumsum(t.changed)])
    for k, s, e in base_spans(t.text):
        if before[e] > before[s]:
            found.add((k, *t.source(s, e)))
    of_kind = {k: ([s for b, s, _ in base if b == k], [e for b, _, e in base if b == k]) for k in KINDS}

    def known(k: str, s: int, e: int) -> bool:
        """Whether a base span of the kind holds it; those of a kind are in order and do not overlap."""
        starts, ends = of_kind[k]
        i = bisect.bisect_right(starts, s) - 1
        return i >= 0 and e <= ends[i]

    return base, sorted((x for x in found if not known(*x)), key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added) of every row.

    A null text is empty; null ids and repeated rows are kept; texts of any length are read whole, in time that grows with
    their length (runs of digits included); other columns are not read; no rows give no rows.
    """
    return scan_rows(docs, find, KINDS, KINDS, id_col, text_col)
