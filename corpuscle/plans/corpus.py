"""Corpus queries: hashes, manifests, filters, chunks."""

from pyspark.sql import functions as F

from corpuscle.functions import hashing, text, values
from corpuscle.operators import chunks, manifest
from corpuscle.operators.relational import first_of, upsert, violations
from corpuscle.plans.base import query, table

#: A path for a document, made of its source, id and language, for operators on paths.
PATH_SQL = "(source || '/' || coalesce(lang, 'xx') || '/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' ELSE '.d.ts' END)"


def _files(spark, d):
    k = F.col("doc_id") % 3
    ending = F.when(k == 0, ".py").when(k == 1, ".min.js").otherwise(".d.ts")
    return table(spark, d, "documents").withColumn("path", F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/d"), "doc_id", ending))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def h1_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("sha256"))


@query("SELECT doc_id, sha256('skip' || chr(0) || ['TooLarge', 'Binary', 'Ignored', 'OutsideRoot', 'NonUtf8Path', 'Unreadable'][doc_id % 6 + 1]) AS hash FROM documents")
def h2_skipped_hash(spark, d):
    reason = F.get(F.array(*map(F.lit, hashing.SKIP_REASONS)), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", hashing.skipped_hash(reason).alias("hash"))


@query("SELECT event_id, sha256('{\"k\":' || (props->>'$.k') || '}') AS digest FROM events")
def h3_json_digest(spark, d):
    return table(spark, d, "events").select("event_id", hashing.json_digest(F.col("props")).alias("digest"))


@query("SELECT event_id, sha256('{\"k\":' || (props->>'$.k') || '}') AS digest FROM events")
def h4_patch_digest(spark, d):
    with_summary = F.concat(F.lit('{"summary": "x", '), F.substring("props", F.lit(2), F.length("props")))
    return table(spark, d, "events").select("event_id", hashing.json_digest(with_summary, ("summary",)).alias("digest"))


@query("SELECT event_id, props->>'$.k' AS k_text, try_cast(props->>'$.k' AS BIGINT) AS k_int FROM events")
def x6_json_field(spark, d):
    return table(spark, d, "events").select("event_id", values.either_case(F.col("props"), "k", "K").alias("k_text"), values.lenient_int(F.get_json_object("props", "$.k")).alias("k_int"))


@query(f"SELECT doc_id, {PATH_SQL} LIKE '%.min.js' AS ignored, n_chars > 4000 AS too_large FROM documents")
def f1_ignore_patterns(spark, d):
    return _files(spark, d).select("doc_id", manifest.ignored(F.col("path"), [*manifest.DENIED, "*.py", "!*.py"]).alias("ignored"), (F.col("n_chars") > 4000).alias("too_large"))


@query(f"""SELECT coalesce(reason, 'taken') AS reason, count(*) AS files FROM (SELECT CASE WHEN {PATH_SQL} LIKE '%.min.js' THEN 'Ignored' WHEN octet_length(encode(text)) > 4000 THEN 'TooLarge' END AS reason FROM documents) GROUP BY 1""")
def f2_skip_reasons(spark, d):
    size = F.octet_length("text")
    reason = manifest.skip_reason(F.col("path"), size, F.encode("text", "UTF-8"), manifest.DENIED, most=4000)
    return _files(spark, d).groupBy(F.coalesce(reason, F.lit("taken")).alias("reason")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000")
def f3_size_cap(spark, d):
    return table(spark, d, "documents").where("n_chars <= 2000").select("doc_id", "n_chars")


@query("SELECT doc_id, doc_id % 2 = 1 AS is_binary FROM documents")
def f4_binary_probe(spark, d):
    rows = table(spark, d, "documents")
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    raw = F.when(F.col("doc_id") % 2 == 1, F.concat(F.unhex(F.lit("4100")), whole)).otherwise(whole)
    return rows.select("doc_id", manifest.binary(raw).alias("is_binary"))


@query(f"SELECT doc_id FROM documents WHERE NOT ({PATH_SQL} LIKE 'src3/%')")
def f5_vendored(spark, d):
    named = F.regexp_replace("path", "^src3/", "node_modules/")
    return _files(spark, d).where(~manifest.vendored(named)).select("doc_id")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'compose' WHEN 1 THEN 'dockerfile' WHEN 2 THEN 'manifest' END AS class FROM part")
def f6_candidates(spark, d):
    name = F.element_at(F.array(*map(F.lit, ["a/docker-compose.dev.yml", "b/Dockerfile.prod", "c/package.json", "d/readme.md"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", manifest.candidate_class(name, ["package.json", "pyproject.toml"]).alias("class"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15' AND value IS NOT NULL")
def f8_live(spark, d):
    return table(spark, d, "events").where((F.col("ts") > F.lit("2024-01-15").cast("timestamp")) & F.col("value").isNotNull()).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def f9_membership(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({PATH_SQL}, '^src1/[^/]*/d[^/]*\\.py$') OR {PATH_SQL} LIKE '%.d.ts'")
def f10_glob(spark, d):
    return _files(spark, d).where(text.glob_match(F.col("path"), "src1/*/d*.py") | text.glob_match(F.col("path"), "*.d.ts")).select("doc_id")


@query(f"""SELECT doc_id, regexp_extract({PATH_SQL}, '[^/]*$') AS base, regexp_replace({PATH_SQL}, '/[^/]*$', '') AS dir, CASE WHEN doc_id % 3 = 0 THEN 'python' WHEN doc_id % 3 = 1 THEN 'javascript' END AS language FROM documents""")
def s1_s3_paths(spark, d):
    p = F.col("path")
    return _files(spark, d).select("doc_id", text.base_name(p).alias("base"), text.dir_name(p).alias("dir"), text.language_of(p).alias("language"))


@query("SELECT doc_id, source || '/b' AS path FROM documents")
def s2_normalise_path(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalise_path(F.concat(F.lit(".././"), F.col("source"), F.lit("/a//../b"))).alias("path"))


@query("""SELECT p_partkey, lower(p_brand) AS repository, CASE p_partkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'kafka' END AS capability FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'bitnami/kafka' ELSE 'acme/api' END AS p_brand FROM part)""")
def s4_s5_images(spark, d):
    image = F.element_at(F.array(*map(F.lit, ["docker.io/library/Postgres:16@sha256:00", "bitnami/kafka:3", "ghcr.io:443/acme/api"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.image_repository(image).alias("repository"), text.image_capability(image).alias("capability"))


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS words FROM documents")
def s16_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.word_tokens(F.col("text"))).alias("words"))


#: Names of all lengths, some of them long, some with nothing that a resource's name may hold.
_NAMES = "CASE p_partkey % 5 WHEN 0 THEN '--' WHEN 1 THEN p_name || ' & ' || p_name || ' ' || p_type WHEN 2 THEN upper(p_name) || '!' ELSE p_name END"


@query(f"SELECT p_partkey, coalesce(nullif(trim(left(regexp_replace(lower({_NAMES}), '[^a-z0-9-]+', '-', 'g'), 32), '-'), ''), 'app') || '-svc' AS slug, regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g') AS raw FROM part")
def s8_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.resource_name(F.expr(_NAMES), F.lit("svc")).alias("slug"), F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "_").alias("raw"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def s13_line_slice(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("lines"))
    return rows.where("lines is not null")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS line FROM documents")
def s14_line_of_byte(spark, d):
    return table(spark, d, "documents").select("doc_id", text.line_of_byte(F.col("text"), F.octet_length("text")).alias("line"))


@query("SELECT source, sum(n_chars)::BIGINT AS total, sum(n_chars) / sum(sum(n_chars)) OVER () AS share FROM documents GROUP BY source")
def a1_shares(spark, d):
    return manifest.shares(table(spark, d, "documents"), "source", "n_chars")


@query("SELECT count(*) FILTER (n_chars <= 3000) AS files_taken, count(*) FILTER (n_chars > 3000) AS files_skipped, (coalesce(sum(n_chars) FILTER (n_chars <= 3000), 0))::BIGINT AS bytes_taken FROM documents")
def a2_a15_counters(spark, d):
    return manifest.counters(table(spark, d, "documents"), F.when(F.col("n_chars") > 3000, "TooLarge"), "n_chars")


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT 'd' || coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def j11_manifest_diff(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("d"), "doc_id"))
    new = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return manifest.diff(manifest.manifest(docs.where("doc_id % 7 <> 0"), "path", "text", "n_chars"), manifest.manifest(new, "path", "text", "n_chars"))


@query("""WITH f AS (SELECT source AS dir, 'd' || doc_id AS n, sha256(text) AS h FROM documents), dirs AS (SELECT dir, sha256(string_agg(n || chr(0) || 'f' || chr(0) || h || chr(10), '' ORDER BY n)) AS h FROM f GROUP BY dir)
SELECT dir AS path, 'dir' AS kind, h AS hash FROM dirs UNION ALL SELECT '', 'dir', sha256(string_agg(dir || chr(0) || 'd' || chr(0) || h || chr(10), '' ORDER BY dir)) FROM dirs""")
def a20_merkle(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.concat("source", F.lit("/d"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return manifest.merkle(files).where("kind = 'dir'")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, ls, unnest(range(0, len(ls), 4)) AS s FROM l)
SELECT doc_id, (s + 1)::INT AS start_line, least(s + 4, len(ls))::INT AS end_line, array_to_string(list_slice(ls, s + 1, least(s + 4, len(ls))), chr(10)) AS content FROM w""")
def w7_line_windows(spark, d):
    return chunks.line_windows(table(spark, d, "documents"), "doc_id", "text", 4)


@query()
def w7_token_chunks(spark, d):
    return chunks.token_chunks(table(spark, d, "documents"), "doc_id", "text", 256)


@query()
def w8_merge_small(spark, d):
    cut = chunks.token_chunks(table(spark, d, "documents"), "doc_id", "text", 64).withColumn("parent", F.lit("p"))
    return chunks.merge_small(cut, "doc_id", "start_line", "parent", "content", "token_count", 48, 128)


@query()
def d19_source_chunks(spark, d):
    files = _files(spark, d).withColumn("language", text.language_of(F.col("path")))
    return chunks.source_chunks(files, "doc_id", "text", "language", 256)


@query("""WITH o AS (SELECT o_orderkey // 32 AS file, o_orderkey, 3 * (row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY o_orderkey) - 1) AS k FROM orders)
SELECT file, (k + 2)::INT AS start_line, (k + 4)::INT AS end_line, 'o' || o_orderkey AS symbol, 'function' AS kind FROM o UNION ALL SELECT DISTINCT o_orderkey // 32, 1, 1, NULL, 'imports' FROM orders""")
def d19_declarations(spark, d):
    """Chunks of source files written here from the orders, 32 keys a file: one function an order, in four languages."""
    in_turn = lambda *words: F.get(F.array(*map(F.lit, words)), (F.col("file") % 4).cast("int"))
    function = F.concat(in_turn("export function", "async function", "pub fn", "func"), F.lit(" o"), "o_orderkey", F.lit('() {\n  "}"; // {\n}\n'))
    files = table(spark, d, "orders").withColumn("file", F.floor(F.col("o_orderkey") / 32)).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", function.alias("f")))).alias("all"))
    source = F.concat(in_turn("import a from 'a';\n", "import 'a';\n", "use a::{b};\n", 'import "a"\n'), F.array_join("all.f", ""))
    files = files.select("file", source.alias("text"), in_turn("typescript", "javascript", "rust", "go").alias("language"))
    return chunks.source_chunks(files, "file", "text", "language", 256).select("file", "start_line", "end_line", "symbol", "kind")


@query()
def d20_embed(spark, d):
    return chunks.hashing_embedding(table(spark, d, "documents"), "doc_id", "text", 16).select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("SELECT s.source, s.lang, count(*) AS docs FROM documents s GROUP BY 1, 2")
def a14_ingest_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"))


@query("SELECT min(doc_id) AS doc_id, source, lower(lang) AS lang FROM documents GROUP BY source, lower(lang)")
def a4_first_of(spark, d):
    rows = table(spark, d, "documents").withColumn("lang", F.lower("lang"))
    return first_of(rows, ["source", "lang"], "doc_id").select("doc_id", "source", "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def snk4_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    base = docs.where("doc_id % 2 = 0 or doc_id % 3 = 0").withColumn("state", F.lit("old"))
    changes = docs.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit("mid").alias("state"), F.lit(1).alias("o")), F.struct(F.lit("new").alias("state"), F.lit(2).alias("o")))).alias("c")).select("doc_id", "c.*")
    return upsert(base, changes, ["doc_id"], "o")


@query("SELECT 'line_span' AS \"check\", count(*) FILTER (NOT coalesce(l_linenumber >= 1, false)) AS broken FROM lineitem UNION ALL SELECT 'ship_after_2000', count(*) FILTER (NOT coalesce(l_shipdate >= TIMESTAMP '1995-01-01', false)) FROM lineitem")
def v1_checks(spark, d):
    return violations(table(spark, d, "lineitem"), {"line_span": F.col("l_linenumber") >= 1, "ship_after_2000": F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")})


@query("SELECT count(*) FILTER (NOT coalesce(len(embedding) = 64, false)) AS broken, 'dimension' AS \"check\" FROM embeddings")
def v5_dimension(spark, d):
    return violations(table(spark, d, "embeddings"), {"dimension": F.size("embedding") == 64})


@query("SELECT event_id, ['Hrs', 'GB-Mo', NULL, 'LCU-Hrs', 'vCPU-Hours'][v % 5 + 1] AS unit, CASE WHEN v BETWEEN 1 AND 65535 THEN v::INT END AS port FROM (SELECT event_id, event_id AS v FROM events)")
def cv1_cv3_conversions(spark, d):
    v = F.col("event_id")
    unit = F.get(F.array(*map(F.lit, [" Hrs", "gb-month", "Quantity", "LCU-Hr", "vCPU-Hrs "])), (v % 5).cast("int"))
    return table(spark, d, "events").select("event_id", values.unit_name(unit).alias("unit"), values.port(F.concat(F.lit(" "), v.cast("string"), F.lit("-70000/tcp"))).alias("port"))
