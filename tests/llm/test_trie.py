"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the rebuilt conversations, by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    new = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        new[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[new[c][:d]].append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in m if len(new[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), sum(not children[q] for q in under), sum(saved[q] for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some(seed, convs=60, words="ab"):
    """Conversations with many common beginnings, copies, repeated turn numbers, and nulls."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 300), convs):
        for k in range(r.choice([1, 2, 3, 5, 9, 12])):
            turn = r.choice([k, k, k, None, 0])
            rows.append((c, turn, r.choice(["user", None, ""]), r.choice([*words, "é" * 3, None])))
    return rows + rows[:7] + [(None, 1, "user", "x")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_against_brute_force(spark, seed, ranges):
    rows = some(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).withColumn("key", F.lit("z")))
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_over_many_ranges(spark):
    rows = [(c, k, "u", "same") for c in range(0, 400, 5) for k in range(3)] + [(c, k, "u", "same") for c in (1000, 1005) for k in range(6)] + [(2000, 0, "u", "other")]
    assert sorted((tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    short = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1]
    got = trie.conversation_trie(spark.createDataFrame([(c, 0, "u", "x") for c in short], SCHEMA)).collect()
    assert [tuple(r)[:6] for r in got] == [(short[0], 0, None, len(short), 0, 1)]
    assert got[0].ends_sha256 == hashlib.sha256(",".join(map(str, short)).encode()).hexdigest()


def test_empty(spark):
    got = trie.conversation_trie(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_very_long_conversation(spark):
    rows = [(5 * c, k, "u", str(k)) for c in range(3) for k in range(3000 + c)] + [(77, 0, "u", "t" * 2_000_000)]
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.agg(F.max("depth")).first()[0] == 3002
    assert got.where("depth = 3000").first().n_convs == 3


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 8])
def test_loser_tree(runs):
    r = random.Random(runs)
    rows = [trie.Sequence(b"".join(bytes([r.randrange(2)]) * trie.SYMBOL for _ in range(r.randrange(12))), c, []) for c in range(40 * runs)]
    held = [trie.sorted_run(rows[k::runs]) for k in range(runs)]
    tree = trie.LoserTree(held)
    got = list(tree)
    assert [(s.key, s.conv) for s, _ in got] == sorted((s.key, s.conv) for s in rows)
    for (a, _), (b, lcp) in zip(got, got[1:], strict=False):
        assert lcp == trie.shared(a.key, b.key)


def test_shared_turns_are_not_compared_again():
    """400 sequences with 500 turns in common, in 8 runs: a merge that compared from the start would look at 500 turns a play."""
    rows = [trie.Sequence(bytes(500 * trie.SYMBOL) + c.to_bytes(trie.SYMBOL, "big"), c, []) for c in range(400)]
    tree = trie.LoserTree([trie.sorted_run(rows[k::8]) for k in range(8)])
    assert [s.conv for s, _ in tree] == list(range(400))
    assert tree.compared < 7 * 501 + 400 * 3 * 2
