"""Text and path functions, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image names by what they serve, first match counts.
IMAGE_CAPABILITIES = [
    (r"^(postgres|postgis|timescale|pgvector|supabase/postgres)", "postgres"),
    (r"^(mysql|mariadb|percona)", "mysql"),
    (r"^(mongo|mongodb)", "mongodb"),
    (r"^(redis|valkey|keydb|redis-stack)", "redis"),
    (r"^(elasticsearch|opensearchproject/opensearch|opensearch)", "elasticsearch"),
    (r"^(qdrant|weaviate|chroma|chromadb|milvus|lancedb)", "vector-search"),
    (r"^(neo4j|janusgraph|arangodb)", "graph-db"),
    (r"^(cassandra|scylla)", "cassandra"),
    (r"^clickhouse", "clickhouse"),
    (r"^rabbitmq", "rabbitmq"),
    (r"^(kafka|confluentinc/|redpanda|bitnami/kafka)", "kafka"),
    (r"^(minio|localstack/s3)", "object-storage"),
    (r"^(ollama|vllm|text-generation-inference|litellm)", "llm-api"),
    (r"^(temporal|apache/airflow|prefecthq|dagster)", "workflow-orchestration"),
    (r"^(prometheus|grafana|jaeger|otel/|prom/|open-?telemetry)", "observability"),
    (r"^(mailhog|mailpit|maildev)", "email"),
    (r"^(keycloak|ory/|dexidp/dex)", "identity"),
    (r"^(vault|hashicorp/vault)", "secrets"),
]


def base_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """All but the last segment; '.' at the root."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def normalise_path(path: Column) -> Column:
    """Resolves '.', '..' and empty segments without leaving the root; '.' if nothing is left."""
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(F.split(path, "/"), none, step)
    return F.when(F.size(kept) == 0, F.lit(".")).otherwise(F.array_join(kept, "/"))


def language_of(path: Column, first_line: Column | None = None) -> Column:
    """Source language by file ending; declaration files and dot files have none; a shebang decides last."""
    name = F.lower(base_name(path))
    ending = F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, F.element_at(F.split(name, "\\."), -1))
    known = {"typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py", "pyi"], "rust": ["rs"], "go": ["go"], "java": ["java"]}
    out = F.when(name.rlike(r"\.d\.[cm]?ts$"), F.lit(None).cast("string"))
    for language, endings in known.items():
        out = out.when(ending.isin(endings), language)
    if first_line is not None:
        out = out.when(ending.isNull() & first_line.rlike(r"^#!.*\bpython"), "python").when(ending.isNull() & first_line.rlike(r"^#!.*\b(node|deno)"), "javascript")
    return out


def image_repository(image: Column) -> Column:
    """An image name without digest, registry host and tag, in lower case, without mirror prefixes."""
    plain = F.element_at(F.split(image, "@"), 1)
    first = F.when(F.instr(plain, "/") > 0, F.element_at(F.split(plain, "/"), 1)).otherwise("")
    host = F.contains(first, F.lit(".")) | F.contains(first, F.lit(":")) | (first == "localhost")
    local = F.when(host, F.regexp_replace(plain, "^[^/]*/", "")).otherwise(plain)
    return F.regexp_replace(F.lower(F.regexp_replace(local, ":[^/]*$", "")), "^(docker\\.io/)*(docker/)*(library/)*", "")


def image_capability(image: Column) -> Column:
    """What a container image serves; null if unknown."""
    repository = image_repository(image)
    return F.coalesce(*(F.when(repository.rlike(p), c) for p, c in IMAGE_CAPABILITIES))


def requirement_name(line: Column) -> Column:
    """Package name of a requirements line; null for options, addresses, comments and blanks."""
    plain = F.trim(F.regexp_replace(line, "#.*$", ""))
    name = F.regexp_extract(plain, r"^([A-Za-z0-9._-]+)", 1)
    return F.when((plain == "") | plain.startswith("-") | plain.contains("://") | (name == ""), None).otherwise(name)


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    """Every match of a pattern's group, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def resource_name(name: Column, suffix: Column, longest: int = 32) -> Column:
    """Lower-case letters, digits and hyphens, cut and without hyphens at the ends, then the suffix; ``app`` if nothing is left."""
    plain = F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), 1, longest)
    stem = F.regexp_replace(plain, "^-+|-+$", "")
    return F.concat_ws("-", F.when(stem == "", "app").otherwise(stem), suffix)


def pypi_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[_.]", "-")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def identifier(name: Column) -> Column:
    """snake_case that never starts with a digit."""
    plain = snake_case(name)
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("r_"), plain)).otherwise(plain)


def folded(text: Column) -> Column:
    """Typographic quotes made plain, white space runs made one blank, lower case."""
    quotes = F.translate(text, "‘’“”´`", "''\"\"''")
    return F.lower(F.trim(F.regexp_replace(quotes, r"\s+", " ")))


def term_in_span(term: Column, span: Column) -> Column:
    """Whether a span holds a term, after folding both; an empty term is held by any span."""
    return F.contains(folded(span), folded(term))


def line_of_byte(text: Column, offset: Column) -> Column:
    """Line, from 1, of a byte offset: line feeds before it, plus one."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "ISO-8859-1")  # a character a byte
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1; null if the text has none of them."""
    lines = F.split(text, "\n")
    count = F.least(last, F.size(lines)) - first + 1
    return F.when((first >= 1) & (count > 0), F.array_join(F.slice(lines, first, F.greatest(count, F.lit(1))), "\n"))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """A stand-in for a subword count: words and single signs."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1)))


def expanded_terms(text: Column) -> Column:
    """Words together with the parts of camelCase and snake_case names, each once, sorted."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    parts = F.flatten(F.transform(names, lambda n: F.split(snake_case(n), "_")))
    whole = F.transform(names, lambda n: F.lower(n))
    return F.array_sort(F.filter(F.array_distinct(F.concat(whole, parts)), lambda w: w != ""))


def signed_usd(amount: Column) -> Column:
    sign = F.when(amount < 0, "-").when(amount > 0, "+").otherwise("")
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(amount), 2))


def percent(share: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob; a glob without '/' is matched at any depth."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif glob[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif glob[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + re.escape(glob[at]), at + 1
    return ("^" if "/" in glob else "^(?:.*/)?") + out + "$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


#: What a message is cut into: fenced blocks, a stray fence, code in line, citations, other text.
_SEGMENT = r"(```[^\n`]*\n[\s\S]*?(?:\n```|\z)|```|`[^`\n]+`|\[(?:file|sku|prediction):[^\]]{1,200}\]|[^`\[]+|[`\[])"


def segments(text: Column) -> Column:
    """A message as (kind, label, value): kinds block (label: its language), code, citation (label: its scheme), text.

    What looks like a mark and is none is text; neighbouring texts are one. Null has no segments.
    """

    def cut(p: Column) -> Column:
        fence, inline = p.rlike(r"\A```[^\n`]*\n"), p.rlike(r"\A`[^`\n]+`\z")
        cite = p.rlike(r"\A\[(?:file|sku|prediction):[^\]]{1,200}\]\z")
        language = F.trim(F.regexp_extract(p, r"\A```([^\n`]*)\n", 1))
        kind = F.when(fence, "block").when(inline, "code").when(cite, "citation").otherwise("text")
        label = F.when(fence & (language != ""), language).when(cite, F.regexp_extract(p, r"\A\[(\w+):", 1))
        inside = F.regexp_extract(p, r"\A```[^\n`]*\n([\s\S]*?)(?:\n```)?\z", 1)
        value = F.when(fence, inside).when(inline, F.regexp_extract(p, "`([^`]+)`", 1)).when(cite, F.regexp_extract(p, r"\A\[\w+:([^\]]+)\]", 1)).otherwise(p)
        return F.struct(kind.alias("kind"), label.alias("label"), value.alias("value"))

    kind = "array<struct<kind:string,label:string,value:string>>"
    pieces = F.transform(F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(1)), cut)

    def put(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("label"), F.concat(last["value"], x["value"]).alias("value"))
        both = (F.size(done) > 0) & (last["kind"] == "text") & (x["kind"] == "text")
        return F.when(both, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x))).cast(kind)

    return F.aggregate(pieces, F.array().cast(kind), put)


_OCTET, _PREFIX = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", "(3[0-2]|[12]?[0-9])"


def is_cidr(text: Column) -> Column:
    """Whether a text is an IPv4 network: four decimals up to 255 and a prefix up to 32, without leading zeros or spaces."""
    return text.rlike(rf"\A{_OCTET}(\.{_OCTET}){{3}}/{_PREFIX}\z")


def literal(value: Column, kind: str, language: str = "terraform") -> Column:
    """A value as a literal of generated code; ``kind`` is string, boolean or number."""
    if kind == "string":
        json = F.to_json(F.array(value))
        return F.substring(json, F.lit(2), F.length(json) - 2)
    if kind == "boolean" and language == "python":
        return F.when(value, "True").otherwise("False")
    return value.cast("string")


def arguments(properties: list[tuple[str, Column, str, bool]], language: str = "terraform") -> Column:
    """``name = literal`` of the properties, a line each, in the order given: (name, value, kind, required).

    A null is left out, and so is an empty text that is not required.
    """
    lines = []
    for name, value, kind, required in properties:
        there = value.isNotNull() if required or kind != "string" else value.isNotNull() & (value != "")
        lines.append(F.when(there, F.concat(F.lit(f"{name} = "), literal(value, kind, language))))
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def in_locale_order(text: Column) -> Column:
    """A text that sorts by the rules of the root locale and not by its bytes."""
    return F.collate(text, "UNICODE")
