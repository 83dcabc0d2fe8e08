"""Personal data by offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. For disguised ones a chain of transducers rewrites the text into a
normal form: look-alike characters and invisible ones, ``[at]`` / ``dot`` disguises, each in brackets, bare or as a sign, and digits
spelled in words (English, German, French, Spanish), alone or mixed with figures where a phone, card or ip results. Each transducer emits edits (source start, source end, replacement); a segment map
composed of them takes any span of the normal form back to source characters. The detectors then run over the normal
form, and spans that touch an edit are added to the plain ones; plain ones always stay.

A text without any cue for a transducer is its own normal form, so most texts are scanned once. All scans are linear
in the text: candidate runs are maximal, and no pattern backtracks over more than its own run.

Edge cases: a null text is empty and has no spans; offsets count code points; rows are independent, so repeated rows
and null ids pass through; an empty table gives an empty result; extra columns are ignored by :func:`find` and kept by
:func:`masked`.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, sliced, table
from .spans import Span, digest, joined, scan_texts

KINDS = ("email", "ip", "card", "phone")

# Characters that look like ASCII ones, invisible characters, and words for digits and signs.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "punto", "point")
PLUS_WORDS = ("plus", "más")


def _wide_digits() -> dict[str, str]:
    """By rule: full-width forms of ASCII, and the decimal digits of other scripts in the first plane."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    return wide | {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x660, 0xFF00) if unicodedata.category(chr(c)) == "Nd"}


_AT, _DOT, _PLUS = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(PLUS_WORDS)
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?:(?:{_PLUS})[ ,-]{{1,3}})?(?:{_DIGIT})(?:[ ,-]{{1,3}}(?:{_DIGIT}|{_DOT}|[0-9]++))+")
_TOKEN = re.compile(r"[^ ,-]+")
_BRACKETED = re.compile(rf" ?[\[({{<] ?({_AT}|@|{_DOT}|\.) ?[\])}}>] ?", re.I)
_NUMBER = rf"(?:(?:{_DIGIT})(?!\w)|[0-9]++(?!\w))"
_MIXED = re.compile(rf"(?<!\w)(?:(?:{_PLUS})[ ,-]{{1,3}}|\+)?{_NUMBER}(?:[ ,().-]{{1,3}}(?:{_NUMBER}|(?:{_DOT})(?!\w)))+")
_PART = re.compile(r"[^ ,().-]+|[ ,().-]+")
_SIGN = re.compile(rf"@| (?:{_AT}|@) ", re.I)
_DISGUISED_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.| (?:{_DOT}) )[A-Za-z0-9-]++)+", re.I)
_BARE_DOT = re.compile(rf" (?:{_DOT}) ", re.I)
_BARE_DOT_BEFORE = re.compile(rf" (?:{_DOT}) \Z", re.I)
_DOT_WIDTH = max(map(len, DOT_WORDS)) + 2
# Words before "at" and a plain host name that speak of a place rather than name a mailbox.
_NOT_LOCAL = frozenset(("and are arrive arrived available be been both but buy check click directly find found from go had has have he her here him hosted i is it join just listed live"
                        " look looked looking looks me meet mirrored more not now off on once online only or order out over page pages published read register see she shop sign site sites"
                        " sold start started stay stayed stop stopped that them there these they this those up us visit was we website were work worked working works you").split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Plain identifiers, leftmost and non-overlapping within each kind."""
    out = _emails(text) if "@" in text else []
    if _DOTTED.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Mapped:
    """A text under rewriting: its present form, and the source span of each of its characters as segments."""

    def __init__(self, text: str):
        self.text, self.edits = text, []  # edits: (start in the present form, length, source start, source end), ascending
        self._index: tuple[list, list[int], list[int]] | None = None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply non-overlapping ascending edits of the present form; older edits inside a new one merge into it."""
        if not edits:
            return
        pieces, moved, at, size, old, k = [], [], 0, 0, self.edits, 0
        shift = 0  # present position minus source position, before the edit being looked at
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            while k < len(old) and old[k][0] < a and old[k][0] + old[k][1] <= a:
                moved.append((size + old[k][0] - at, *old[k][1:]))
                shift = old[k][0] + old[k][1] - old[k][3]
                k += 1
            pieces.append(self.text[at:a])
            size += a - at
            if (a, b) == (len(self.text), len(self.text)) and not new:
                break
            start = a - shift
            while k < len(old) and old[k][0] < b:
                if old[k][0] < a:
                    start = old[k][2]
                shift = old[k][0] + old[k][1] - old[k][3]
                k += 1
            end = max(b - shift, start)
            moved.append((size, len(new), start, end))
            pieces.append(new)
            size += len(new)
            at = b
        for x in old[k:]:
            moved.append((size - (len(self.text) - x[0]), *x[1:]))
        self.text, self.edits = "".join(pieces), sorted(moved)

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Source span of [a, b) of the present form, and whether an edit is inside; by bisection over the edits."""
        if self._index is None or self._index[0] is not self.edits:
            self._index = self.edits, [x[0] for x in self.edits], [x[0] + x[1] for x in self.edits]
        _, ats, ends = self._index
        upto = bisect_left(ats, b)  # edits before it begin before the end of the span
        first = min(bisect_right(ends, a), upto)  # the first that reaches into the span
        start = self.edits[first][2] if first < upto and ats[first] <= a else a - self._shift(first - 1)
        touched = any(ats[k] + max(self.edits[k][1], 1) > a for k in range(max(0, upto - 2), upto))
        last = bisect_left(ends, b)
        if last < upto:
            return start, self.edits[last][3], True
        return start, b - self._shift(upto - 1), touched

    def _shift(self, k: int) -> int:
        """Present position minus source position behind edit k."""
        return self.edits[k][0] + self.edits[k][1] - self.edits[k][3] if k >= 0 else 0


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _has_digit_run(low: str) -> bool:
    """Whether three digit words stand within six tokens: only such runs are taken for spelled numbers."""
    words = low.replace("-", " ").replace(",", " ").split()
    found = [i for i, w in enumerate(words) if w in DIGIT_WORDS]
    return any(b - a <= 5 for a, b in zip(found, found[2:]))


_BLANK = str.maketrans("-,().", "     ")
_ANY_DIGIT = re.compile(r"[0-9]")


def _has_number(low: str) -> bool:
    """Whether a digit word stands beside another part of a number."""
    words = low.translate(_BLANK).split()
    if DIGIT_WORDS.keys().isdisjoint(words):
        return False
    return any(w in DIGIT_WORDS and any(x in DIGIT_WORDS or x in DOT_WORDS or x in PLUS_WORDS or x.lstrip("+")[:1].isdigit() for x in (*words[max(0, i - 1):i], *words[i + 1:i + 2]))
               for i, w in enumerate(words))


def _mixed_numbers(low: str) -> list[tuple[int, int, str]]:
    """Edits that join the parts of numbers in words and digits, where the result is a phone, card or ip."""
    edits = []
    for x in _MIXED.finditer(low):
        parts = [(x.start() + p.start(), x.start() + p.end(), p.group()) for p in _PART.finditer(x.group())]
        if not any(w in DIGIT_WORDS for _, _, w in parts):
            continue
        new = ["+" if w in PLUS_WORDS else "." if w in DOT_WORDS or w == "." else DIGIT_WORDS.get(w, "" if w[0] in " ,().-" else w) for _, _, w in parts]
        if detect("".join(new)):
            edits += [(a, b, n) for (a, b, w), n in zip(parts, new) if n != w]
    return edits


def _disguised_emails(text: str) -> list[tuple[int, int, str]]:
    """Edits that write at and dot as signs, each in whatever form, around what is shaped like an e-mail address."""
    edits, done = [], 0
    for x in _SIGN.finditer(text):
        start = x.start()
        if start <= done or text[start - 1] not in _LOCAL:
            continue
        m = _DISGUISED_DOMAIN.match(text, x.end())
        if not m:
            continue
        dots, at = [], start
        while at > done and text[at - 1] in _LOCAL:
            at -= 1
            if at > done and text[at - 1] == " ":
                y = _BARE_DOT_BEFORE.search(text, max(done, at - _DOT_WIDTH), at)
                if y and y.start() > done and text[y.start() - 1] in _LOCAL:
                    dots.append((y.start(), y.end(), "."))
                    at = y.start()
        dots.reverse()
        after = [(y.start(), y.end(), ".") for y in _BARE_DOT.finditer(text, m.start(), m.end())]
        if x.group().strip() != "@" and not dots and not after:
            last = m.group().rsplit(".", 1)[1]
            if text[at:start].lower() in _NOT_LOCAL or not (len(last) > 1 and last.isalpha() and last.islower()):
                continue
        edits += [*dots, *([(start, x.end(), "@")] if x.group() != "@" else []), *after]
        done = m.end()
    return edits


def normalise(text: str, look: re.Pattern, table_: dict[str, str]) -> Mapped | None:
    """The normal form of ``text``, or None if no transducer finds a cue."""
    m = Mapped(text)
    if not text.isascii():
        m.rewrite([(x.start(), x.end(), "".join(table_[c] for c in x.group())) for x in look.finditer(text)])
    low = _lowered(m.text)
    edits = []
    run = _has_digit_run(low)
    for x in _SPELLED.finditer(low) if run else ():
        if (x.start() and low[x.start() - 1].isalnum()) or (x.end() < len(low) and low[x.end()].isalpha()):
            continue
        words = _TOKEN.findall(x.group())
        if sum(w in DIGIT_WORDS for w in words) >= 3:
            new = "".join("+" if w in PLUS_WORDS else "." if w in DOT_WORDS else DIGIT_WORDS.get(w, w) for w in words)
            edits.append((x.start(), x.end(), new))
    m.rewrite(edits)
    low = _lowered(m.text) if edits else low
    if (run or _ANY_DIGIT.search(low)) and _has_number(low):
        m.rewrite(_mixed_numbers(low))
    if any(c in m.text for c in "[({<"):
        m.rewrite([(x.start(), x.end(), "." if x[1].lower() in DOT_WORDS or x[1] == "." else "@") for x in _BRACKETED.finditer(m.text)])
    if "@" in m.text or any(f" {w} " in low for w in AT_WORDS):
        m.rewrite(_disguised_emails(m.text))
    return m if m.edits else None


def finder():
    """A function from a text to (plain spans, added spans)."""
    table_ = _wide_digits() | LOOKALIKES | dict.fromkeys(INVISIBLE, "")
    look = re.compile("[" + "".join(map(re.escape, table_)) + "]+")

    def find_in(text: str) -> tuple[list[Span], list[Span]]:
        plain, added = detect(text), []
        m = normalise(text, look, table_)
        if m is not None:
            starts = {k: [a for kind, a, _ in plain if kind == k] for k in KINDS}
            ends = {k: [b for kind, _, b in plain if kind == k] for k in KINDS}
            for kind, a, b in detect(m.text):
                a, b, touched = m.source(a, b)
                # Plain spans of a kind ascend without overlap: those that end behind a and begin before b.
                if touched and bisect_right(ends[kind], a) >= bisect_left(starts[kind], b):
                    added.append((kind, a, b))
        return plain, added

    return find_in


COLUMNS = [("n_email", pa.int64(), "bigint"), ("n_ip", pa.int64(), "bigint"), ("n_card", pa.int64(), "bigint"), ("n_phone", pa.int64(), "bigint"),
           ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string"), ("n_added", pa.int64(), "bigint")]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of plain spans by kind, their digest, all spans, and the number of added ones, per document."""
    def setup():
        find_in = finder()

        def row(text: str) -> tuple:
            plain, added = find_in(text)
            kinds = [k for k, _, _ in plain]
            return (*[kinds.count(k) for k in KINDS], digest(plain, KINDS), joined(plain + added, KINDS), len(added))
        return row
    return scan_texts(docs, id_col, text_col, setup, COLUMNS)


def mask_text(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at and out:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with identifiers masked in the text (null stays null) and the length column brought up to date."""
    names = docs.columns
    new, = fresh(docs, "masked")
    at = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(new, T.StringType())])

    def run(batches):
        find_in = finder()
        for part in sliced(batches, at):
            if part.num_rows:
                texts = [t and mask_text(t, sum(find_in(t), [])) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, new])

    out = docs.mapInArrow(run, schema)
    fixed = {text_col: col(new), **({chars_col: F.length(col(new)).cast(docs.schema[chars_col].dataType)} if chars_col in names else {})}
    return out.select(*[fixed.get(c, col(c)).alias(c) for c in names])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
