"""Retrieval queries."""

from pyspark.sql import functions as F

from corpuscle.functions import numeric, text
from corpuscle.operators import retrieval
from corpuscle.operators.relational import latest
from corpuscle.plans.base import query, table

_COS = "1 - list_sum(list_transform(list_zip(e.embedding, p.v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(p.v, lambda x: x::DOUBLE * x::DOUBLE))))"


def _probe(spark, d):
    """The vector of the smallest id: one bounded row."""
    row = table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row[0]) if row else [0.0]


@query(f"SELECT vec_id, round({_COS}, 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) p ORDER BY {_COS}, vec_id LIMIT 10")
def k1_vector_topk(spark, d):
    top = retrieval.vector_topk(table(spark, d, "embeddings"), _probe(spark, d), 10, "vec_id", "embedding")
    return top.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, 1.0::DOUBLE AS unit_length FROM embeddings")
def m13_m14_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(numeric.norm(F.col("embedding")), 6).alias("length"), F.round(numeric.norm(numeric.unit(F.col("embedding"))), 6).alias("unit_length"))


_TOK = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOK.format('text')}, ['the', 'of'])")
def f13_match_all(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.match_all(docs, text.word_tokens(F.col("text")), F.array(F.lit("the"), F.lit("of"))).select("doc_id")


@query(f"SELECT doc_id, source FROM documents WHERE list_contains({_TOK.format('text')}, 'the') ORDER BY source, doc_id LIMIT 20")
def k2_search_page(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.match_all(docs, text.word_tokens(F.col("text")), F.array(F.lit("the"))).select("doc_id", "source").orderBy("source", "doc_id").limit(20)


@query("""SELECT a.l_orderkey AS k, a.l_linenumber AS lo, a.l_linenumber + 1 AS hi, b.l_linenumber AS a_lo FROM lineitem a JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <= b.l_linenumber + 1 AND a.l_linenumber + 1 >= b.l_linenumber""")
def j8_span_overlap(spark, d):
    li = table(spark, d, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + 1).alias("hi"))
    asked = li.where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a_lo"), (F.col("l_linenumber") + 1).alias("a_hi"))
    return retrieval.overlapping(spans, asked, "k").select("k", "lo", "hi", "a_lo")


@query("""SELECT l_orderkey AS k, l_linenumber AS lo FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 40 AND b.l_orderkey = a.l_orderkey AND a.l_linenumber >= b.l_linenumber AND a.l_linenumber <= b.l_linenumber + 2)""")
def j9_covered(spark, d):
    li = table(spark, d, "lineitem")
    claims = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), F.col("l_linenumber").alias("hi"))
    reads = li.where("l_quantity > 40").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("r_lo"), (F.col("l_linenumber") + 2).alias("r_hi"))
    return retrieval.covered(claims, reads, ["k"]).select("k", "lo")


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS lo, l_linenumber + (l_partkey % 4)::INT AS hi FROM lineitem)
SELECT k, lo, hi FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND a.lo <= b.lo AND a.hi >= b.hi AND (a.lo < b.lo OR a.hi > b.hi))""")
def j10_innermost(spark, d):
    li = table(spark, d, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + (F.col("l_partkey") % 4).cast("int")).alias("hi"))
    return retrieval.innermost(spans, "k", "k").select("k", "lo", "hi")


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM documents) GROUP BY term")
def a21_term_stats(spark, d):
    df, _ = retrieval.term_stats(table(spark, d, "documents"), "doc_id", text.word_tokens(F.col("text")))
    return df


_BM25 = f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), n AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d), q AS (SELECT item_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM benchmark),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) ORDER BY term), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) """


def _bm25(spark, d):
    queries = table(spark, d, "benchmark")
    return retrieval.bm25(table(spark, d, "documents"), queries, "doc_id", text.word_tokens(F.col("text")), "item_id", text.word_tokens(F.col("text")), 5)


@query(_BM25 + "SELECT item_id, doc_id, round(score, 4) AS score FROM r WHERE rank <= 5")
def m19_bm25(spark, d):
    return _bm25(spark, d).select("item_id", "doc_id", F.round("score", 4).alias("score"))


def _lists(spark, d):
    ev = table(spark, d, "events")
    one = latest(ev, ["event_type"], [F.desc("value"), "event_id"], 10)
    from pyspark.sql.window import Window

    rank = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(*order))).select("event_type", "user_id", "rank")
    users = ev.groupBy("event_type", "user_id").agg(F.max("value").alias("value"), F.count("*").alias("n"))
    return one, rank(users, F.desc("value"), "user_id").where("rank <= 20"), rank(users, F.desc("n"), "user_id").where("rank <= 20")


_LISTS = """WITH u AS (SELECT event_type, user_id, max(value) AS value, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS rank FROM u QUALIFY rank <= 20),
b AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM u QUALIFY rank <= 20), f AS (SELECT event_type, user_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0) AS score FROM a FULL JOIN b USING (event_type, user_id)) """


@query(_LISTS + "SELECT event_type, user_id, round(score, 9) AS score, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) AS rank FROM f QUALIFY rank <= 10")
def m18_rank_fusion(spark, d):
    _, a, b = _lists(spark, d)
    return retrieval.fuse([(a, 1.0), (b, 0.5)], "event_type", "user_id", 10).select("event_type", "user_id", F.round("score", 9).alias("score"), "rank")


@query(_LISTS + """, g AS (SELECT event_type, user_id, (user_id % 4)::INT AS grade FROM u), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY grade DESC, user_id) AS rank FROM g),
t AS (SELECT event_type, sum((pow(2.0, grade) - 1) / log2(rank + 1.0) ORDER BY rank) FILTER (rank <= 10) AS idcg, count(*) FILTER (grade >= 2) AS n FROM i GROUP BY 1), h AS (SELECT event_type, sum((pow(2.0, grade) - 1) / log2(rank + 1.0)) AS dcg, count(*) FILTER (grade >= 2) AS found, min(rank) FILTER (grade >= 2) AS first FROM a JOIN g USING (event_type, user_id) WHERE rank <= 10 GROUP BY 1)
SELECT event_type, round(coalesce(found, 0) / n, 6) AS recall, round(coalesce(dcg, 0) / idcg, 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM t LEFT JOIN h USING (event_type)""")
def a23_metrics(spark, d):
    _, a, _ = _lists(spark, d)
    grades = table(spark, d, "events").select("event_type", "user_id").distinct().withColumn("grade", (F.col("user_id") % 4).cast("int"))
    out = retrieval.metrics(a, grades, "event_type", "user_id", 10)
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def a23_percentile(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
