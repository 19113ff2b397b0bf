"""Personal data: plain patterns, and disguised ones found through an offset-preserving transducer.

Transducers rewrite homoglyphs, invisible characters, character references, spaced-out letters, spelled digits and at/dot disguises (in
English, German, French and Spanish), and keep for every character they write the source stretch it stands for. Identifiers are then
detected in the normalised text and their spans mapped back, so spans always index the source text in code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting a match inside a run of digits can succeed only where starting at its head does: the look-behind saves quadratic time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    return out


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; matches that fail their test are dropped, not retried."""
    out = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


_GLYPHS = {a: b for a, b in zip("аеорсухіјѕһԁԛԝвкмнтАВЕКМНОРСТХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwbkmhtABEKMHOPCTXIJSaopvikABEZHIKMNOPTYX", strict=True)}
_GLYPHS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"　": " ", " ": " ", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@"}
_GLYPHS |= {chr(0x660 + k): str(k) for k in range(10)} | {chr(0x6F0 + k): str(k) for k in range(10)} | {chr(base + k): str(k) for base in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
_GLYPHS |= {c: "" for c in "​‌‍⁠﻿­"}
#: Digits by name: English, German, French, Spanish.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGITS |= {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_DIGITS |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_DIGITS |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
#: A digit said after one of these counts so often.
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3, "dreimal": 3}


def _trie(words: list[str]) -> str:
    """A regular expression for the words, the longest first, that reads shared beginnings once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    end = heads.pop("", None)
    return "(?:" + "|".join(re.escape(h) + _trie(rest) for h, rest in heads.items()) + ")" + ("?" if end else "") if heads else ""


_NAME = _trie(list(_DIGITS))
#: Searched for in lower-cased text before anything that needs the name of a digit.
_ANY_NAME = re.compile(rf"\b{_NAME}\b")
_SAID = rf"(?:(?:{'|'.join(_TIMES)})[\s-]{{1,2}}(?:{_NAME}|[0-9])|{_NAME})"
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")
#: References to printable ASCII characters.
_REFERENCE = re.compile(r"&(?:#0{0,4}([0-9]{2,3})|#[xX]0{0,4}([2-7][0-9a-fA-F])|(commat|period|plus|lowbar|hyphen|lpar|rpar));")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-", "lpar": "(", "rpar": ")"}
_AT, _DOT_WORD = "at|ät|arobase|arroba|klammeraffe", "dot|punkt|point|punto"
#: Top-level names that a bare "x at y dot z" must end in.
TOP = "com|org|net|edu|gov|info|io|co|us|uk|de|fr|es|it|nl|eu|example|test"
_OPEN, _SHUT = r"[\[({<]\x20{0,3}", r"\x20{0,3}[\])}>]"
_DOT = rf"(?:\x20{{0,3}}{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}\x20{{0,3}}|\x20{{1,3}}(?:{_DOT_WORD})\x20{{1,3}})"
_DISGUISE = re.compile(
    rf"(?P<head>(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]{{1,64}}){{0,4}}?)"
    rf"(?P<at>\x20{{0,3}}{_OPEN}(?:{_AT}|@){_SHUT}\x20{{0,3}}|\x20{{0,3}}@\x20{{0,3}}|\x20{{1,3}}(?:{_AT})\x20{{1,3}})"
    rf"(?P<tail>[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT}|\x20\.\x20)[A-Za-z0-9-]{{1,63}}){{1,6}})",
    re.IGNORECASE,
)
_DOTS = re.compile(rf"{_DOT}|\x20\.\x20", re.IGNORECASE)
#: The same with words joined by underscores or hyphens.
_JOINED = re.compile(r"(?<![A-Za-z0-9_-])(?P<head>[A-Za-z0-9.]{1,64})(?P<j>[_-])at(?P=j)(?P<tail>[A-Za-z0-9]{1,63}(?:(?P=j)dot(?P=j)[A-Za-z0-9]{1,63}){1,6})(?![A-Za-z0-9_-])", re.IGNORECASE)
_DOTS_OR_DOT = re.compile(rf"{_DOT}|\.", re.IGNORECASE)
_JOINED_DOT = re.compile(r"[_-]dot[_-]", re.IGNORECASE)
_HINT = re.compile(rf"[\[({{<]\x20{{0,3}}(?:{_AT}|{_DOT_WORD}|@|\.)\x20{{0,3}}[\])}}>]|\x20(?:{_DOT_WORD})\x20|@\x20|\x20@|[_-]at[_-]", re.IGNORECASE)
#: Four numbers with disguised dots between them, or with some of their digits spelled.
_NUMBER = rf"(?:[0-9]{{1,3}}|{_SAID}(?:\x20{_SAID}){{0,2}})"
_DOTTED = re.compile(rf"(?<![\w.]){_NUMBER}(?:(?:\.|{_DOT}){_NUMBER}){{3}}(?!\w)", re.IGNORECASE)
_DISGUISED_DOT = re.compile(rf"[0-9]{_DOT}[0-9]", re.IGNORECASE)
_NAMED_DOT = re.compile(rf"\b{_NAME}(?:\.|{_DOT})|(?:\.|{_DOT}){_NAME}\b", re.IGNORECASE)
#: Digits, at least `LEAST_SPELLED` of them spelled.
_SPELLED = re.compile(rf"(?:\bplus[\s,.-]{{1,3}}|\+)?\b(?:{_SAID}|[0-9]{{1,6}})\b(?:[\s,.()-]{{1,3}}(?:{_SAID}|[0-9]{{1,6}})\b){{3,}}", re.IGNORECASE)
_SPELLED_WORD = re.compile(r"[^\W\d_]+|[0-9]+")
LEAST_SPELLED = 3
_SPELLED_HINT = re.compile(rf"\b{_NAME}[\s,.-]{{1,3}}{_SAID}\b", re.IGNORECASE)
#: Single characters with one space between them, as many as the shortest address has.
_SPACED = re.compile(r"(?<![^\s])(?:[A-Za-z0-9._%+@-]\x20){6,}[A-Za-z0-9](?![^\s])")


class Tape:
    """A text with, for every character, the source stretch it came from, kept by segments: as many as there are edits."""

    def __init__(self, text: str, segments: list[tuple[int, int, int, bool]] | None = None):
        self.text = text
        #: first character written, source start and end, and whether the source is copied character by character
        self.segments = [(0, 0, len(text), True)] if segments is None else segments
        self.firsts = [s[0] for s in self.segments]

    def _parts(self, a: int, b: int) -> Iterator[tuple[int, int, int, bool]]:
        """Segments of the characters from a to b: length, source start and end, copied."""
        k = bisect_right(self.firsts, a) - 1
        while a < b:
            first, start, end, copied = self.segments[k]
            stop = min(b, self.firsts[k + 1] if k + 1 < len(self.firsts) else len(self.text))
            yield (stop - a, start + a - first, start + stop - first, True) if copied else (stop - a, start, end, False)
            a, k = stop, k + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace stretches (start, end, by) in order; every written character stands for all its stretch."""
        text, segments, at, size = [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            for n, start, end, copied in self._parts(a, b):
                segments.append((size, start, end, copied))
                size += n
            text.append(self.text[a:b])

        for a, b, by in edits:
            if a < at or a == b:
                continue
            copy(at, a)
            if by:
                segments.append((size, *self.source(a, b), False))
                size += len(by)
                text.append(by)
            at = b
        copy(at, len(self.text))
        return Tape("".join(text), segments)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return next(self._parts(start, start + 1))[1], next(self._parts(end - 1, end))[2]


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), _GLYPHS[m.group()]) for m in _GLYPH.finditer(text)]


def _reference_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _REFERENCE.finditer(text):
        code = _NAMED.get(m.group(3)) or chr(int(m.group(1)) if m.group(1) else int(m.group(2), 16))
        if " " <= code <= "~":
            out.append((*m.span(), code))
    return out


def _spaced_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPACED.finditer(text):
        name, _, host = m.group().replace(" ", "").partition("@")
        if name and _DOMAIN.fullmatch(host) and re.search(rf"\.(?:{TOP})$", host, re.IGNORECASE):
            out += [(m.start() + k, m.start() + k + 1, "") for k in range(1, m.end() - m.start(), 2)]
    return out


def _mail_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _DISGUISE.finditer(text):
        bare = "@" not in m.group("at") and not re.search(r"[\[({<]", m.group("at"))
        tail = _DOTS.sub(".", m.group("tail"))
        start = m.start("head")
        if bare or m.group("at") != "@" and "@" in m.group("at"):  # only words around a bare "at" are told from prose by a disguised dot and a known ending
            if not (_DOTS.search(m.group("tail")) or "@" in m.group("at")) or not re.search(rf"\.(?:{TOP})$", tail, re.IGNORECASE):
                continue
        for d in _DOTS.finditer(m.group("head")):
            out.append((start + d.start(), start + d.end(), "."))
        out.append((*m.span("at"), "@"))
        for d in _DOTS.finditer(m.group("tail")):
            out.append((m.start("tail") + d.start(), m.start("tail") + d.end(), "."))
    for m in _JOINED.finditer(text):
        if re.search(rf"(?:{TOP})$", m.group("tail"), re.IGNORECASE):
            out.append((m.end("head"), m.start("tail"), "@"))
            out += [(m.start("tail") + d.start(), m.start("tail") + d.end(), ".") for d in _JOINED_DOT.finditer(m.group("tail"))]
    return sorted(out)


def _said(stretch: str) -> tuple[str, int]:
    """The digits of a stretch of names and numbers, and how many words were names."""
    out, named, times = [], 0, 1
    for w in _SPELLED_WORD.findall(stretch):
        low = w.lower()
        if low in _TIMES:
            times = _TIMES[low]
            continue
        if low in _DIGITS or w.isdigit():
            out.append(_DIGITS.get(low, w) * times)
            named += low in _DIGITS
        times = 1
    return "".join(out), named


def _dotted_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _DOTTED.finditer(text):
        at = m.start()
        for d in [*_DOTS_OR_DOT.finditer(m.group()), None]:
            end = m.end() if d is None else m.start() + d.start()
            if not text[at:end].isdigit():
                out.append((at, end, _said(text[at:end])[0]))
            if d is not None:
                at = m.start() + d.end()
                out.append((end, at, "."))
    return out


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        digits, named = _said(m.group())
        if named >= LEAST_SPELLED:
            out.append((*m.span(), "+" * (m.group()[0] == "+" or m.group()[:4].lower() == "plus") + digits))
    return out


def _names_digits(text: str) -> bool:
    return _ANY_NAME.search(text.lower()) is not None


#: Transducers in order, each with a cheap test of whether it can find anything.
_TRANSDUCERS = (
    (lambda t: not t.isascii(), _glyph_edits), (lambda t: "&" in t, _reference_edits), (lambda t: "@ " in t, _spaced_edits), (_HINT.search, _mail_edits),
    (lambda t: _DISGUISED_DOT.search(t) or _names_digits(t) and _NAMED_DOT.search(t), _dotted_edits), (lambda t: _names_digits(t) and _SPELLED_HINT.search(t), _digit_edits),
)


def disguised_spans(text: str) -> list[Span]:
    """Spans in the source of identifiers that only the normalised text shows."""
    tape, spelled, changed = Tape(text), [], False
    for likely, edits_of in _TRANSDUCERS:
        if likely(tape.text) and (edits := edits_of(tape.text)):
            if edits_of is _digit_edits:
                for a, b, by in edits:
                    digits = by.lstrip("+")
                    kind = "card" if 14 <= len(digits) <= 19 and luhn(digits) else "phone" if 10 <= len(digits) <= 15 else None
                    if kind:
                        spelled.append((kind, *tape.source(a, b)))
            tape, changed = tape.rewrite(edits), True
    if not changed:
        return []
    out = list(spelled)
    for kind, a, b in plain_spans(tape.text):
        s, e = tape.source(a, b)
        if text[s:e] != tape.text[a:b]:
            out.append((kind, s, e))
    return out


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each by start, then kind; disguised ones that meet a plain one of their kind, or an earlier disguised one, are left out."""
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    plain = sorted(plain_spans(text), key=key)
    spans = list(plain)
    hidden = disguised_spans(text)
    if hidden:
        starts = {k: [s[1] for s in plain if s[0] == k] for k in KINDS}
        ends = {k: [s[2] for s in plain if s[0] == k] for k in KINDS}
        last = dict.fromkeys(KINDS, 0)
        for kind, a, b in sorted(set(hidden), key=key):
            before = bisect_left(starts[kind], b)
            if last[kind] <= a and (before == 0 or ends[kind][before - 1] <= a):
                spans.append((kind, a, b))
                last[kind] = b
    return plain, sorted(spans, key=key)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, of the first one's kind."""
    out, at, open_ = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if open_ and a < open_[2]:
            open_ = (open_[0], open_[1], max(open_[2], b))
            continue
        if open_:
            out += [text[at : open_[1]], f"[{open_[0].upper()}]"]
            at = open_[2]
        open_ = (kind, a, b)
    if open_:
        out += [text[at : open_[1]], f"[{open_[0].upper()}]"]
        at = open_[2]
    return "".join(out) + text[at:]


_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches):
    for b in batches:
        rows = []
        for text in b.column(1):
            plain, spans = find_spans(text.as_py() or "")
            rows.append((*[sum(s[0] == k for s in plain) for k in KINDS], hashlib.sha256(join_spans(plain).encode()).hexdigest(), join_spans(spans)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(_SCHEMA)[1:], strict=True)]], schema=_SCHEMA)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (plain matches), base_sha256 (of the plain spans), spans (all).

    A null text is empty and has no spans; spans count code points, end exclusive. Repeated rows are scanned each, other columns ignored; an
    empty table gives no rows. Time is linear in the text: every pattern has bounded or unambiguous repeats.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs`, all its columns, with personal data in the text replaced by [KIND]; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else redact_text(t, find_spans(t)[1]))

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op3_pii_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
