"""Personal data: plain identifiers against the patterns as given, disguised ones by round trips."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    return sorted((k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group()))


@pytest.mark.parametrize("letters", ["a@.-", "1.@a", "14 -+", "+1 ().-2", "1.25 0", "a1@._b-% ", "é9+4- 2.@x"])
def test_plain_identifiers_against_the_patterns(letters):
    r = random.Random(letters)
    found = 0
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randrange(60)))
        assert sorted(pii.identifiers(text)) == brute(text), text
        found += len(brute(text))
    assert found


def test_cards_by_their_check_digit():
    assert pii.identifiers("4111 1111-1111 1111") == [("card", 0, 19)]
    assert pii.identifiers("4111 1111 1111 1112") == pii.identifiers("0" * 13) == pii.identifiers("0" * 20) == []


LOOK = dict(zip("aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ", strict=True))
WORDS = "zero one two three four five six seven eight nine".split()


def wide(s):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)


def spell(s):
    return " ".join(WORDS[int(c)] for c in s)


DISGUISES = {
    "email": [
        wide, lambda s: s.replace("@", " [at] ").replace(".", " [dot] "), lambda s: s.replace("@", "(AT)").replace(".", "(DOT)"), lambda s: s.replace("@", " at ").replace(".", " dot "),
        lambda s: s.replace("@", " @ "), lambda s: s.replace("@", "&#64;").replace(".", "&#46;"), lambda s: s[:1] + "​" + s[1:], lambda s: s.replace("a", LOOK["a"]).replace("e", LOOK["e"]),
        lambda s: s.replace("@", " arobase ").replace(".", " point "), lambda s: s.replace("@", " {at} "), lambda s: s.replace("@", "＠"),
    ],
    "ip": [wide, lambda s: s.replace(".", " dot "), lambda s: " dot ".join(map(spell, s.split("."))), lambda s: ".".join(map(spell, s.split("."))), lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " punkt ")],
    "card": [wide, spell, lambda s: s.replace("1", "l", 2).replace("0", "O", 2), lambda s: "".join(chr(0x660 + int(c)) for c in s), lambda s: s[:8] + "⁠" + s[8:], lambda s: "‐".join(s[k : k + 4] for k in range(0, len(s), 4))],
    "phone": [wide, lambda s: "plus " + spell(s[1:]), lambda s: "plus " + s[1:], lambda s: "＋" + s[1:], lambda s: f"{s[:4]}‑{s[4:]}"],
}
PLAIN = {"email": ["jane.poe@mail.example.com", "xaver@example.org"], "ip": ["192.168.0.17", "8.8.4.4"], "card": ["4111111111111111", "5500005555555559"], "phone": ["+14155550123", "+4930123456789"]}


@pytest.mark.parametrize("kind", pii.KINDS)
def test_disguises_round_trip(kind):
    """Every disguise of every identifier is found, just where it stands."""
    for before in ("", "Écrivez à ", "Call ñ: ", "ж "):
        for after in ("", " ça va", "\nThe end."):
            for plain in PLAIN[kind]:
                assert (kind, len(before), len(before) + len(plain)) in pii.find(before + plain + after)[0]
                for n, disguise in enumerate(DISGUISES[kind]):
                    new = disguise(plain)
                    found = pii.find(before + new + after)[1]
                    assert (kind, len(before), len(before) + len(new)) in found, (n, before + new + after, found)


@pytest.mark.parametrize("text", [
    "We met at noon at the café. One of them left at one.", "Look at that dot on the map at the end", "un, deux, trois: quatre cinq six", "m² und 10³ – ½ Liter", "Section 1.2.3 at page 4 dot", "plus one two", "x @ y",
    "Москва и Санкт-Петербург", "one two three four five six seven", "null eins", "[at] [dot]", "f(at) = g(x)", "10 % 40 &amp; 64", "а" * 1000,
])
def test_clean_text_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_offsets_after_many_rewritings():
    text = "​".join("abcdefgh") + " jane​ at mail dot example dot com ​+49 30 123456 ＠ one nine two dot one dot two dot three"
    spans = pii.find(text)[1]
    assert [(k, text[a:b]) for k, a, b in sorted(spans, key=lambda s: s[1])] == [("email", "jane​ at mail dot example dot com"), ("phone", "+49 30 123456"), ("ip", "one nine two dot one dot two dot three")]


def test_tape_maps_both_ways():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices("abxy", k=30))
        tape, origin = pii.Tape(text), [(k, k + 1) for k in range(30)]
        for pattern, new in (("x", ""), ("yy", "q"), ("a", "mn"), ("nb", "z"), ("qm", "o")):
            out, now, at = [], tape.text, 0
            for m in re.finditer(pattern, now):
                span = (origin[m.start()][0], origin[m.end() - 1][1])
                out += origin[at : m.start()] + [span] * len(new)
                at = m.end()
            origin = out + origin[at:]
            tape.rewrite(re.compile(pattern), lambda m, new=new: new)
            assert len(tape.text) == len(origin)
        for a in range(len(origin)):
            for b in range(a + 1, len(origin) + 1):
                assert tape.source_span(a, b) == (origin[a][0], origin[b - 1][1])


@pytest.mark.parametrize("unit", ["a", "1", "1.", "+1", "a.", "@", "one ", "a at ", "a dot ", " ", "[ ", "1 dot ", "a @ a.", "0O ", "plus ", "a.b at ", "double "])
def test_long_texts_take_linear_time(unit):
    began = time.time()
    pii.find(unit * (600_000 // len(unit)) + "@")
    assert time.time() - began < 5


def test_table(spark):
    rows = [(1, "a@b.c and +1 415 555 0100 1"), (1, "a@b.c and +1 415 555 0100 1"), (2, None), (None, "8.8.8.8"), (4, ""), (5, "x at y dot com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_email", F.lit(9))
    got = sorted(map(tuple, pii.scan(docs).collect()), key=str)
    empty, digest = hashlib.sha256(b"").hexdigest(), lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = "email:0:5,phone:10:27"
    one = (1, 1, 0, 0, 1, digest(both), both, 0)
    assert got == sorted([one, one, (2, 0, 0, 0, 0, empty, "", 0), (None, 0, 1, 0, 0, digest("ip:0:7"), "ip:0:7", 0), (4, 0, 0, 0, 0, empty, "", 0), (5, 0, 0, 0, 0, empty, "email:0:14", 1)], key=str)
    assert pii.scan(docs.limit(0)).count() == 0


def test_query_against_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        spans = sorted(brute(r.text or ""), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        want[r.doc_id] = ([sum(s[0] == k for s in spans) for k in pii.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
    from corpuscle.llm.queries import QUERIES

    for r in QUERIES["op12_pii"](spark, "/root/testdata/sf0.001").collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == want.pop(r.doc_id)
        assert r.n_disguised == 0  # the tables hold no disguised data
    assert not want
