"""Personal data in plain and disguised form, with offsets into the text as it stands."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.llm.common import in_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- identifiers in text as it stands -----------------------------------------------------------------------------

# Each pattern begins where its run of characters begins and keeps what it took, so that a search is linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit fits: from the right, every second digit is doubled."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @ the longest run of name characters before it, as far as the last address, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def identifiers(text: str) -> list[Span]:
    """(kind, start, end) of all identifiers of the four kinds, each kind leftmost and without overlap."""
    found: list[Span] = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return found


# --- transducers --------------------------------------------------------------------------------------------------


class Tape:
    """A text and, for every rewriting that led to it, where its pieces came from."""

    def __init__(self, text: str):
        self.source = self.text = text
        self.steps: list[tuple[list[int], list[int], list[int], list[int]]] = []  # out start, out end, source start, source end

    def rewrite(self, pattern: re.Pattern, put: Callable[[re.Match], str | None]) -> None:
        """Replaces matches; ``put`` may leave one as it is by None."""
        pieces, cuts, at, out = [], ([], [], [], []), 0, 0
        for m in pattern.finditer(self.text):
            new = put(m)
            if new is None or new == m.group():
                continue
            out += m.start() - at
            pieces += [self.text[at : m.start()], new]
            for c, x in zip(cuts, (out, out + len(new), m.start(), m.end()), strict=True):
                c.append(x)
            out, at = out + len(new), m.end()
        if pieces:
            self.text = "".join([*pieces, self.text[at:]])
            self.steps.append(cuts)

    def _back(self, x: int, end: bool) -> int:
        for starts, ends, from_, to in reversed(self.steps):
            k = bisect_right(starts, x - 1 if end else x) - 1  # the last rewriting that begins before
            if k >= 0:
                x = (to[k] if end else from_[k]) if x - end < ends[k] else to[k] + x - ends[k]
        return x

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        """The characters of the source that a span of the text stands for."""
        return self._back(start, False), self._back(end, True)


#: Letters that look like Latin ones but do not decompose to them.
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТУХаеорсухіјѕԁһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρυıɡ٫·․‧∙⋅。",
    "ABEKMHOPCTYXaeopcyxijsdhlqwABEZHIKMNOPTYXovapuig.......", strict=True))
#: Characters without width, and soft hyphens.
INVISIBLE = "­​‌‍⁠﻿᠎‎‏"
_DASHES = "‐‑‒–—―−﹘"


def _folds() -> dict[str, str]:
    """What to read for characters outside ASCII: by compatibility, digits of other scripts by value, the rest by look."""
    out = {}
    for c in map(chr, range(0x80, 0x20000)):
        plain, digit = unicodedata.normalize("NFKC", c), unicodedata.decimal(c, None)
        if digit is not None:
            out[c] = str(digit)
        elif len(plain) == 1 and plain.isascii() and unicodedata.category(c) != "No":  # no superscripts, no fractions
            out[c] = plain
    return out | LOOKALIKES | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(_DASHES, "-") | {c: " " for c in "    "}


FOLDS = _folds()


def _classes(chars) -> str:
    """A character class of sorted code points, runs of them as ranges."""
    runs: list[list[int]] = []
    for x in sorted(map(ord, chars)):
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_FOLD = re.compile(_classes(FOLDS))

#: The digits in the languages of the corpus.
DIGIT_WORDS = {
    w: str(k)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, w in enumerate(words.split())
} | {"oh": "0"}
_TIMES = {"double": 2, "triple": 3}
_AT, _DOT, _PLUS = r"(?:at|arroba|arobase|klammeraffe)", r"(?:dot|punkt|point|punto)", r"(?:plus|más|mas)"
_WORD = r"(?:(?:double|triple) )?(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")(?!\w)"
#: A run of spelled digits, with the sign before it. It takes all it can and never fails after its first word.
_SPELLED = re.compile(rf"(?<!\w)(?:{_PLUS} )?{_WORD}(?:[ -]{_WORD})*+", re.I)
_ANY_WORD = re.compile(rf"(?<!\w){_WORD}", re.I)
_NEXT_DOT, _LAST_DOT = re.compile(rf"\.| {_DOT} ", re.I), re.compile(rf"(?:\.| {_DOT} )$", re.I)
_SPOKEN_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\.| {_DOT} )[0-9]{{1,3}}){{3}}(?!\w)", re.I)
_PLUS_NUMBER = re.compile(rf"(?<!\w){_PLUS} (?=[0-9])", re.I)
_LEET = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ -]?[0-9OoIl]){13,18}+(?![A-Za-z0-9])")
_BRACKET_AT = re.compile(rf"(?<![\s\[({{<])\s{{0,3}}[\[({{<]\s{{0,3}}(?:@|{_AT})\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_BRACKET_DOT = re.compile(rf"(?<![\s\[({{<])\s{{0,3}}[\[({{<]\s{{0,3}}(?:\.|{_DOT})\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_ENTITY_AT = re.compile(r"&#0*64;|&#[xX]0*40;|&commat;|%40")
_ENTITY_DOT = re.compile(r"&#0*46;|&#[xX]0*2[eE];|&period;|%2[eE]")
_ANY_AT = re.compile(rf"@|(?<![A-Za-z0-9]){_AT}(?![A-Za-z0-9])", re.I)
_ANY_DOT = re.compile(rf"(?<![A-Za-z0-9]){_DOT}(?![A-Za-z0-9])", re.I)
_NAME = r"[A-Za-z0-9_%+-]++"
#: Last parts of a domain that are no words of a sentence, as "in", "is" or "to" are; asked of spoken addresses.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name dev app ai io eu uk us ca au nz ie de fr es ch nl be lu dk se fi pl cz pt gr ru ua jp cn kr tw br mx ar cl za tr".split())
#: A name, a disguised or spaced @ and a domain with at least one spelled dot and a last part of letters.
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?<!dot )(?<!punkt )(?<!point )(?<!punto ){_NAME}(?:(?:\.| {_DOT} ){_NAME})*+(?: ?@ ?| {_AT} )[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?: {_DOT} [A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)++", re.I)
#: A plainly written domain after an @ between spaces.
_SPACED = re.compile(r"(?<=[A-Za-z0-9]) @ (?=[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z])")
_INNER_AT, _INNER_DOT = re.compile(rf" ?@ ?| {_AT} ", re.I), re.compile(rf" {_DOT} ", re.I)


def _number(words: str) -> str:
    """The digits that a run of words spells."""
    out, times = "", 1
    for w in re.split("[ -]", words.lower()):
        if w in _TIMES:
            times = _TIMES[w]
        else:
            out, times = out + DIGIT_WORDS[w] * times, 1
    return out


def _spelled(m: re.Match) -> str | None:
    """A number, if it has three digits or a sign, or is part of a dotted one."""
    words = m.group()
    sign = re.match(rf"{_PLUS} ", words, re.I)
    digits = _number(words[sign.end() :] if sign else words)
    if len(digits) < 3 and not sign and not _NEXT_DOT.match(m.string, m.end()) and not _LAST_DOT.search(m.string[max(0, m.start() - 8) : m.start()]):
        return None
    return ("+" if sign else "") + digits


def _leet(m: re.Match) -> str | None:
    if sum("0" <= c <= "9" for c in m.group()) < 10:
        return None
    return m.group().translate(str.maketrans("OoIl", "0011"))


def _spoken(m: re.Match) -> str | None:
    """One @, whatever stands for it, and all dots."""
    new = _INNER_DOT.sub(".", _INNER_AT.sub("@", m.group(), count=1))
    return new if new.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else None


def normalised(text: str) -> Tape | None:
    """The text with disguises undone; None if there are none to undo.

    In turn: characters outside ASCII that stand for ASCII ones; entities; dots and @ in brackets; spelled digits and
    addresses; letters among the digits of a card; spoken and spaced e-mail addresses.
    """
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_FOLD, lambda m: FOLDS[m.group()])
    if "&" in tape.text or "%" in tape.text:
        tape.rewrite(_ENTITY_AT, lambda m: "@")
        tape.rewrite(_ENTITY_DOT, lambda m: ".")
    if re.search(r"[\[({<]", tape.text):
        tape.rewrite(_BRACKET_AT, lambda m: "@")
        tape.rewrite(_BRACKET_DOT, lambda m: ".")
    if _ANY_WORD.search(tape.text):
        tape.rewrite(_SPELLED, _spelled)
    dots = _ANY_DOT.search(tape.text) is not None
    if dots:
        tape.rewrite(_SPOKEN_IP, lambda m: _INNER_DOT.sub(".", m.group()))
    tape.rewrite(_PLUS_NUMBER, lambda m: "+")
    tape.rewrite(_LEET, _leet)
    if _ANY_AT.search(tape.text):
        tape.rewrite(_SPACED, lambda m: "@")
        if dots:
            tape.rewrite(_SPOKEN, _spoken)
    return tape if tape.steps else None


_TOP = re.compile(r"\.[A-Za-z]{2,24}$")


def disguised(text: str) -> list[Span]:
    """(kind, start, end) in the text of identifiers that only show once disguises are undone."""
    tape = normalised(text)
    if tape is None:
        return []
    out = []
    for kind, a, b in identifiers(tape.text):
        start, end = tape.source_span(a, b)
        if tape.text[a:b] != text[start:end] and (kind != "email" or _TOP.search(tape.text, a, b)):
            out.append((kind, start, end))
    return out


def joined(spans: list[Span]) -> str:
    order = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Identifiers in a text as it stands, and all: with those in disguise."""
    text = text or ""
    plain = identifiers(text)
    return plain, plain + disguised(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_disguised for every document.

    Counts and digest are of identifiers that stand in the text undisguised; ``spans`` has the disguised ones as well, as
    kind:start:end in characters of the text as it is, by start. A disguised one may lie over a plain one that is a part of it.
    A null text is empty; rows with null or repeated ids stay as they are; other columns are ignored. An empty table
    gives an empty one. Work is linear in a text's length, and every row by itself: nothing is shuffled.
    """
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for text in b.column(1).to_pylist():
                plain, every = find(text)
                kinds = [k for k, _, _ in plain]
                values = [*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every), len(set(every)) - len(plain)]
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
    return docs.select(id_col, text_col).transform(in_batches, run, schema)
