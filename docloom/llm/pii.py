"""Personal data: exact base patterns, and disguised forms found in a normalised text and mapped back.

A finite-state rewriting pass turns look-alike characters into ASCII, spelled digits into digits and
written-out ``at`` and ``dot`` into ``@`` and ``.``, and notes for each character it writes the source
span it came from. The base detectors then read the rewritten text; a hit that rests on rewritten
characters is mapped back to source code points and added, unless it meets a base hit of its kind.

Base spans: leftmost, not overlapping within a kind; matches that fail the number checks are dropped.
All passes are linear in the text, runs of blanks included. Null and empty texts have no spans. Every row gives one row,
repeated ones too; an empty table gives none.

What stays out, to leave prose alone: a plain ``at`` before a host counts only with a common last label, and not after a word
that a site follows in prose (``PLACED``); spelled digits count in English, German, French and Spanish.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, chosen, only, slices, texts_of, trimmed

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends where its last run of digits ends, so none can begin within a run.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches around each ``@``: the run of local characters before it, the domain after it; linear in the text."""
    spans, free = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            spans.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return spans


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base patterns' spans by kind, in order of start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        found["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


DIGIT = re.compile("[0-9]").search

# Letters of other scripts that look like Latin ones, and marks that look like ASCII ones.
# Each pair: characters, then what they look like.
LOOK_ALIKES = {
    c: plain
    for plain, others in {
        "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еε", "h": "һ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "ո",
        "o": "оο", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ѡω", "x": "хχ", "y": "уγ",
        "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
        "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
        "-": "‐‑‒–—―−﹣", ".": "․。｡·", "@": "﹫", "+": "﹢", " ": "\u00a0\u2007\u2009\u202f",
    }.items()
    for c in others
}
GONE = "­​‌‍⁠﻿"
# English, German, French and Spanish; "ein", "une" and "una" are left out, as they are not said of digits.
SPELLED = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "null eins zwo drei vier fuenf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
}
NUMBER = "|".join(f"{c}(?:{'|'.join(w[1:] for w in SPELLED if w[0] == c)})" for c in dict.fromkeys(w[0] for w in SPELLED))


def one_for_one() -> dict[str, str]:
    table = dict(LOOK_ALIKES) | {c: "" for c in GONE}
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"　": " "}
    for c in range(128, 0x20000):
        if unicodedata.category(chr(c)) == "Nd":
            table[chr(c)] = str(unicodedata.digit(chr(c)))
    return table


GLYPHS = one_for_one()
NARROW = [c for c in GLYPHS if ord(c) < 256]
GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
# Blanks are taken whole and only from their first on, so that a run of them is read once.
OPEN, SHUT = r"(?<![ \t])[ \t]*+[\[({<][ \t]*+", r"[ \t]*+[\])}>][ \t]*+"
AT = "at|@|arroba|arobase|chez|ät|klammeraffe"
DOT = rf"(?:{OPEN}(?:dot|punto|punkt|point|\.){SHUT}|[ \t]++dot[ \t]++)"
# Last labels after which a plain "at ... dot" counts as an address.
DOMAINS = "com|org|net|edu|gov|mil|info|biz|dev|app|io|co|ai|eu|uk|de|fr|es|nl|ch|pl|pt|ru|se|ca|au|jp|cn|br|mx"
COUNTRIES = (
    "ac|ad|ae|af|ag|al|am|ao|aq|ar|as|at|aw|ax|az|ba|bb|bd|be|bf|bg|bh|bi|bj|bm|bn|bo|bs|bt|bw|by|bz|cc|cd|cf|cg|ci|ck|cl|cm|cr|cu|cv|cw|cx|cy|cz|dj|dk|dm|do|dz|ec|ee|eg|er|et"
    "|fi|fj|fk|fm|fo|ga|gd|ge|gf|gg|gh|gi|gl|gm|gn|gp|gq|gr|gs|gt|gu|gw|gy|hk|hm|hn|hr|ht|hu|id|ie|il|im|in|iq|ir|is|it|je|jm|jo|ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|la|lb|lc|li|lk|lr|ls|lt|lu|lv|ly"
    "|ma|mc|md|me|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|my|mz|na|nc|ne|nf|ng|ni|no|np|nr|nu|nz|om|pa|pe|pf|pg|ph|pk|pm|pn|pr|ps|pw|py|qa|re|ro|rs|rw|sa|sb|sc|sd|sg|sh|si|sk|sl|sm|sn|so|sr|ss|st|sv|sx|sy|sz"
    "|tc|td|tf|tg|th|tj|tk|tl|tm|tn|to|tr|tt|tv|tw|tz|ua|ug|us|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw"
)
# Before "dot in" and the like these are prose ("look at the dot in"), no hosts.
ARTICLES = "a|an|the|this|that|each|every|any|some|one|no|its|his|her|their|my|our|your|which|what"
# Words that a plain "at example.com" follows in prose ("visit us at example.com"): they are no local parts.
PLACED = set(
    "us|me|you|him|her|them|it|we|they|this|that|these|those|here|there|now|today|online|only|also|directly|again|and|or|but|is|are|was|were|be|been"
    "|look|looks|looked|looking|visit|visits|find|found|see|seen|read|more|available|hosted|sold|live|lives|located|based|meet|stay|shop|buy|order|work|works|worked|working"
    "|job|jobs|page|pages|site|sites|website|store|blog|info|information|details|published|posted|listed|register|registered|sign|contact|arrive|arrived|start|starts|started|began|aimed".split("|")
)
LABEL = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
HOSTS = rf"{LABEL}(?:{DOT}{LABEL})*{DOT}"
SPOKEN = rf"{HOSTS}(?:{DOMAINS})\b|(?!(?:{ARTICLES})[ \t]){HOSTS}(?:{COUNTRIES})\b"
WRITTEN = rf"(?:[A-Za-z0-9-]++\.)+(?:{DOMAINS})\b"
DISGUISES = re.compile(
    rf"(?P<at>{OPEN}(?:{AT}){SHUT}(?=[A-Za-z0-9-])|(?<=[A-Za-z0-9_])[ \t]++at[ \t]++(?={SPOKEN}))"
    rf"|(?P<site>(?<=[A-Za-z0-9_])[ \t]++at[ \t]++(?={WRITTEN}))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus[ \t]++(?=[0-9]|(?:{NUMBER})\b))"
    rf"|(?P<number>\b(?:{NUMBER})(?:[ \t-]+(?:{NUMBER}))*\b)",
    re.IGNORECASE,
)
WORD_BEFORE = re.compile(r"[^\W_]+\Z")


def placed(text: str, end: int) -> bool:
    """Whether the word that ends at ``end`` is one that an address of a site follows in prose."""
    word = WORD_BEFORE.search(text, max(0, end - 24), end)
    return bool(word) and word[0].lower() in PLACED


def glyphed(text: str) -> bool:
    """Whether a text holds a character that is rewritten one for one."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(GLYPH.search(text))
    return any(c in text for c in NARROW)


class Rewritten:
    """A rewritten text and, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Rewritten:
        """Another, with the spans ``changes`` of the present text, given in order, replaced."""
        out, starts, ends, at = [], [], [], 0
        for a, b, new in [*changes, (len(self.text), len(self.text), "")]:
            out += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        made = Rewritten("".join(out))
        made.starts, made.ends = starts, ends
        return made


def digit_of(word: str) -> str:
    """A spelled digit's digit; case is ignored as :data:`DISGUISES` does it."""
    return SPELLED.get(word.lower()) or next(d for w, d in SPELLED.items() if re.fullmatch(w, word, re.IGNORECASE))


def rewritings(text: str) -> list[Rewritten]:
    """The rewritten texts, fullest first: with all disguises, without spelled digits, with glyphs alone.

    The lesser ones keep what a number word of the prose beside it would spoil.
    """
    glyphs = Rewritten(text)
    if glyphed(text):
        glyphs = glyphs.rewrite([(m.start(), m.end(), GLYPHS[m[0]]) for m in GLYPH.finditer(text)])
    marks, digits = [], []
    for m in DISGUISES.finditer(glyphs.text):
        if m.lastgroup == "number":
            # digit by digit, so that each keeps its own source span; blanks between spelled digits go
            for w in re.finditer(rf"({NUMBER})\b([ \t-]*)", m[0], re.IGNORECASE):
                digits.append((m.start() + w.start(1), m.start() + w.end(1), digit_of(w[1])))
                if w[2]:
                    digits.append((m.start() + w.start(2), m.start() + w.end(2), ""))
        elif m.lastgroup != "site" or not placed(glyphs.text, m.start()):
            marks.append((*m.span(), {"at": "@", "site": "@", "dot": ".", "plus": "+"}[m.lastgroup]))
    made = [glyphs.rewrite(sorted(marks + digits))] if digits else []
    made += [glyphs.rewrite(marks)] if marks else []
    return [x for x in [*made, glyphs] if x.text != text]


def meets(spans: list[Span], start: int, end: int) -> bool:
    i = bisect_left(spans, (start, end))
    return (i < len(spans) and spans[i][0] < end) or (i > 0 and spans[i - 1][1] > start)


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, base and added spans), each by kind in order of start."""
    base = base_spans(text)
    total = base
    for made in rewritings(text):
        more = {}
        for kind, spans in base_spans(made.text).items():
            more[kind] = []
            for a, b in spans:
                start, end = made.starts[a], made.ends[b - 1]
                if text[start:end] != made.text[a:b] and not meets(total[kind], start, end):
                    more[kind].append((start, end))
        total = {kind: sorted(total[kind] + more[kind]) for kind in KINDS}
    return base, total


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str) -> str:
    """The text with each span as ``<KIND>``; of overlapping spans the first names the whole."""
    _, spans = all_spans(text)
    flat = sorted((a, -b, k) for k in KINDS for a, b in spans[k])
    if not flat:
        return text
    out, at, i = [], 0, 0
    while i < len(flat):
        a, end, kind = flat[i][0], -flat[i][1], flat[i][2]
        while i + 1 < len(flat) and flat[i + 1][0] < end:
            i += 1
            end = max(end, -flat[i][1])
        out += [text[at:a], f"<{kind.upper()}>"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = texts_of(b.column(1))
        for i, j in slices(texts, 1 << 22):
            rows = [all_spans(t) for t in texts.slice(i, j - i).to_pylist()]
            counts = {f"n_{k}": [len(base[k]) for base, _ in rows] for k in KINDS}
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
            yield batch(FOUND_ARROW, doc_id=b.column(0).slice(i, j - i), **counts, base_sha256=digests, spans=[written(s) for _, s in rows])


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts by kind of base spans, their digest, and all spans, for each row of ``docs``; no shuffle."""
    return chosen(docs).mapInArrow(_find, FOUND)


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind; all other columns stay, null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for b in batches:
            for i, j in slices(texts_of(b.column(at)), 1 << 22):
                part = b.slice(i, j - i)
                new = pa.array([t if t is None else redact(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return docs.mapInArrow(trimmed(run), docs.schema)
