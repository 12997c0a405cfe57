"""The pipeline's stages against their operators' decisions, one after the other."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from corpuscle.llm import decontaminate, quality, shingles, simhash

SF = "/root/testdata/sf0.001"


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    language, clean, one, safe, pack = (f for _, f in p.STAGES)
    a = language(spark, docs, SF)
    assert ids(docs) - ids(a) == {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    b = clean(spark, a, SF)
    scored = quality.score(a, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(b) == ids(scored.where("keep")) and len(ids(b)) < len(ids(a))
    c = one(spark, b, SF)
    sets = {r.doc_id: shingles.shingle_set(shingles.words_of(r.text), 5) for r in b.collect()}
    near = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    classes = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(classes)
        for i, j in near:
            classes[i] = classes[j] = min(classes[i], classes[j])
        if before == classes:
            break
    exact, got = {i for i in sets if classes[i] == i}, ids(c)
    assert exact == got
    d = safe(spark, c, SF)
    items = [shingles.shingle_set(shingles.words_of(r.text), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in c.collect() for s in [shingles.shingle_set(shingles.words_of(r.text), 5)] if any(len(x & s) >= 0.8 * len(x) for x in items)}
    assert ids(d) == ids(c) - leaked and decontaminate.BLOCK_ITEMS > 0
    assert all(x.columns == columns for x in (a, b, c, d))
    out = pack(spark, d, SF)
    assert ids(out) == ids(d)
    assert ids(p.run(spark, SF)) == ids(d)


def test_near_copies_are_found_whole(spark):
    """All copies at 0.8 are in one class and no others, for word edits, cuts, additions and a large group."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 50_000, n)]
    texts = []
    for _ in range(60):
        w = word(int(rng.integers(40, 400)))
        for kind in range(6):
            v, cut = list(w), int(len(w) * rng.uniform(0.02, 0.3))
            if kind == 1:
                v = v[:-cut]
            elif kind == 2:
                v = v + word(cut)
            elif kind == 3:
                for at in rng.integers(0, len(v), max(1, cut // 6)):
                    v[at] = word(1)[0]
            elif kind == 4:
                v = v[cut:] + v[:cut]
            elif kind == 5:
                v = v[: len(v) // 2] + word(cut) + v[len(v) // 2 :]
            texts.append(" ".join(v))
    base = word(120)
    for _ in range(250):  # a group whose members are near the base, above and below the threshold among themselves
        v = list(base)
        for at in rng.integers(0, len(v), 3):
            v[at] = word(1)[0]
        texts.append(" ".join(v))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [shingles.shingle_set(shingles.words_of(t), 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == dict(enumerate(root))


def test_language_stage_drops_what_no_language_knows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    odd = [(-1, "Это совсем другой язык, которого фильтры не знают и знать не могут вовсе."), (-2, "xqzvk wzzqx kkvvq zxqj vvkq jjxz qqkz wvxk zzqj xvkq jqzx kvwq"), (-3, "1234 5678"), (-4, None)]
    more = spark.createDataFrame([(i, t, "en" if i == -3 else None, "s", 0) for i, t in odd], docs.schema)
    stage = dict(p.STAGES)["language"]
    kept = ids(stage(spark, docs.unionByName(more), SF))
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    unlabelled = more.withColumn("lang", F.lit(None).cast("string"))
    assert ids(stage(spark, unlabelled, SF)) == {-1, -2}


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in p.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_extra_columns_and_nulls(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "lang_pred", "label"]
    docs = spark.createDataFrame([(1, None, None, None, None, 2.0, "x", 1), (None, "a few plain words of a text", "en", "s", 3, 0.25, "own", 2), (3, "", "fr", "s", 0, 1.0, None, 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, label int")
    for name, f in p.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == names, name
        assert all((r.score, r.lang_pred, r.label) == (0.25, "own", 2) for r in docs.collect()), name
    assert [r.doc_id for r in docs.collect()] in ([None], [])


def test_near_duplicate_work_grows_with_texts_that_share_words(spark, monkeypatch):
    """Texts of 120 shared shingles and 60 own words, none alike, with a common table that does not hold the shared ones."""
    from corpuscle.llm import simhash

    sizes, kept = [], simhash.keep

    def counting(df, label, codec="zstd"):
        out = kept(df, label, codec)
        if label == "pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "keep", counting)
    monkeypatch.setattr(simhash, "COMMON_SHINGLES", 16)
    made = []
    for m in (60, 240):
        sizes.clear()
        rows = [(i, " ".join([f"s{k}" for k in range(124)] + [f"o{i}x{k}" for k in range(60)])) for i in range(m)]
        rows.append((m, rows[0][1] + " end"))  # one is alike
        got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(m)} | {m: 0}
        made.append(sum(sizes))
    assert made[1] < 6 * made[0]


def test_class_links_against_all_pairs(spark):
    """Every two fingerprints of a lane within two bits and in different classes are linked, but for sizes and sketches that rule it out."""
    rng = np.random.default_rng(11)
    rows = []
    for lane in range(3):
        for _ in range(12):
            base = int(rng.integers(0, 1 << 63))
            for _ in range(12):
                fp = base
                for bit in rng.choice(64, int(rng.integers(0, 3)), replace=False):
                    fp ^= 1 << int(bit)
                rep, sketch = len(rows), [int(x) for x in rng.integers(0, 1 << 40, 2)] if rng.random() < 0.5 else [None, None]
                rows.append((lane, fp - (1 << 64) if fp >> 63 else fp, rep - rep % int(rng.choice([1, 2])), rep, int(rng.choice([40, 100, 104])), *sketch))
    kinds = "lane int, fp long, class long, rep long, size int, sketch_0 long, sketch_1 long"
    got = [tuple(sorted(r)) for r in simhash.class_links(spark.createDataFrame(rows, kinds), 0.8).collect()]
    expected, ruled_out = set(), 0
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0] and a[2] != b[2] and ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= 2:
                unlike = sum((x ^ y).bit_count() for x, y in zip(a[5:], b[5:], strict=True)) if None not in (a[5], b[5]) else 0
                if min(a[4], b[4]) >= 0.8 * max(a[4], b[4]) and 9 * unlike <= a[4] + b[4]:
                    expected.add((b[3], a[3]))
                else:
                    ruled_out += 1
    assert set(got) == expected and len(expected) > 300 and ruled_out > 300


def test_simhash_alone_ties_all_groups_within_two_bits(spark, monkeypatch):
    """Chains of edits, each text near the one before and not the commonest: the covering alone, without prefixes, finds all their links."""
    rng = np.random.default_rng(7)
    texts = []
    for chain in range(6):
        w = [f"w{chain}x{k}" for k in rng.integers(0, 5000, 160)]
        for _ in range(25):
            w = list(w)
            w[int(rng.integers(len(w)))] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(w))
    monkeypatch.setattr(simhash, "_shared_prefixes", lambda heads: heads.selectExpr("0L shingle", "rep", "size", "0 place").where("false"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    sets = [shingles.shingle_set(shingles.words_of(t), 5) for t in texts]
    lanes = [simhash.lanes_of(t, 8) for t in texts]
    expected = {i: i for i in range(len(texts))}
    links = [(j, i) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (np.bitwise_count(lanes[i] ^ lanes[j]) <= 2).any()]
    for _ in texts:
        for j, i in links:
            expected[i] = expected[j] = min(expected[i], expected[j])
    assert got == expected and len(set(expected.values())) < len(texts) / 2
