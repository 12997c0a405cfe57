"""Application profiles: manifests, signatures, components, citations."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.relational import latest, longest_prefix

#: Words in a path and capabilities that decide what a component is.
TEST_SEGMENTS = ["test", "tests", "__tests__", "e2e", "spec", "specs", "integration-tests", "acceptance-tests", "load-tests", "regression-tests", "benchmarks"]
EXAMPLE_SEGMENTS = ["example", "examples", "sample", "samples", "poc", "pocs", "demo", "demos", "fixtures", "templates", "_templates", "scaffold", "skeleton", "storybook"]
LIBRARY_SEGMENTS = ["packages", "libs", "lib", "shared", "common", "internal"]
WORK = ["background-jobs", "workflow-orchestration", "streaming", "kafka", "rabbitmq"]
SERVING = ["http-server", "graphql", "grpc", "websocket", "mcp-server"]
MODEL = ["ml-inference", "gpu-inference", "embeddings", "llm-api", "document-processing"]
LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.5, 0.9

_NAME = re.compile(r"[A-Za-z0-9._-]+")


def _requirement(line: str) -> str | None:
    plain = line.split("#")[0].strip()
    m = _NAME.match(plain)
    return None if not m or plain.startswith("-") or "://" in plain else m[0]


def _table(value) -> dict:
    return value if isinstance(value, dict) else {}


def parse_manifest(name: str, content: str) -> tuple[str | None, str | None, bool, list[str]]:
    """Ecosystem, package name, whether it looks like a library, and dependencies of one manifest file."""
    if name == "package.json":
        m = _table(json.loads(content))
        runs = m.get("private") is True or isinstance(m.get("scripts"), dict)
        return "npm", m.get("name") if isinstance(m.get("name"), str) else None, "workspaces" in m or not runs, [*_table(m.get("dependencies")), *_table(m.get("devDependencies"))]
    if name.startswith("requirements") and name.endswith(".txt"):
        return "pypi", None, False, [n for n in map(_requirement, content.split("\n")) if n]
    if name == "pyproject.toml":
        m = tomllib.loads(content)
        project, poetry = _table(m.get("project")), _table(_table(m.get("tool")).get("poetry"))
        listed = [n for x in project.get("dependencies") or [] if isinstance(x, str) and (n := _requirement(x))]
        return "pypi", project.get("name") or poetry.get("name"), False, [*listed, *(d for d in _table(poetry.get("dependencies")) if d != "python")]
    if name == "Cargo.toml":
        m = tomllib.loads(content)
        package = _table(m.get("package"))
        return "cargo", package.get("name"), "package" not in m and "workspace" in m, [*_table(m.get("dependencies")), *_table(m.get("dev-dependencies"))]
    if name == "go.mod":
        lines = [x.split("//")[0].strip() for x in content.split("\n")]
        module = next((x.removeprefix("module ").strip() for x in lines if x.startswith("module ")), None)
        block = re.findall(r"^require\s*\(\s*$(.*?)^\s*\)", "\n".join(lines), re.S | re.M)
        inside = [x.split()[0] for b in block for x in b.split("\n") if x.strip()]
        return "go", module, False, [*(m[1] for x in lines if (m := re.match(r"require\s+([^\s(]+)", x))), *inside]
    if name in ("pom.xml", "build.gradle", "build.gradle.kts"):
        found = [*re.findall(r"<artifactId>\s*([^<\s]+)\s*</artifactId>", content), *re.findall(r"""['"][\w.-]+:([\w.-]+)(?::[^'"]*)?['"]""", content)]
        return "maven", None, False, list(dict.fromkeys(found))
    if name == "Gemfile":
        return "rubygems", None, False, re.findall(r"""^\s*gem\s+['"]([^'"]+)['"]""", content, re.M)
    if name == "composer.json":
        m = _table(json.loads(content))
        return "packagist", m.get("name"), False, [d for d in [*_table(m.get("require")), *_table(m.get("require-dev"))] if d != "php" and not d.startswith("ext-")]
    return None, None, False, []


def manifests(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, ecosystem, name, library_hint, dependencies and error of manifest files. Files that do not parse say so."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b[path_col], b[content_col], strict=True):
                try:
                    rows.append((path, *parse_manifest(path.rsplit("/", 1)[-1], content or ""), None))
                except (ValueError, tomllib.TOMLDecodeError) as e:
                    rows.append((path, None, None, False, [], type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "name", "library_hint", "dependencies", "error"])

    return files.select(path_col, content_col).mapInPandas(parse, "path string, ecosystem string, name string, library_hint boolean, dependencies array<string>, error string")


def signatures(deps: DataFrame, table: DataFrame) -> DataFrame:
    """Dependencies (ecosystem, name) with category and capability, or nulls.

    table: ecosystem, name, category, capability; a dimension. Names match exactly, PyPI names in canonical form, Go
    modules by the longest listed path.
    """
    exact = F.when(F.col("ecosystem") == "pypi", text.pypi_name(F.col("name"))).otherwise(F.col("name"))
    others = deps.where("ecosystem <> 'go'").withColumn("k", exact).join(table.withColumnRenamed("name", "k"), ["ecosystem", "k"], "left").drop("k")
    go = table.where("ecosystem = 'go'").select(F.col("name").alias("module"), "category", "capability")
    modules = longest_prefix(deps.where("ecosystem = 'go'"), go.select("module"), "name", "module").join(go, "module", "left").drop("module")
    return others.unionByName(modules.select(*others.columns))


def drafts(rows: DataFrame) -> DataFrame:
    """One draft a directory: names, ecosystems, dependencies as sets, library only if every manifest says so.

    rows: path, ecosystem, name, library_hint, dependencies.
    """
    return rows.groupBy(text.dir_name(F.col("path")).alias("path")).agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("path"))).alias("name"), F.array_sort(F.collect_set("ecosystem")).alias("ecosystems"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dependencies")))).alias("dependencies"), F.every("library_hint").alias("library_hint"), F.array_sort(F.collect_list("path")).alias("manifests"))


def distinct_dependencies(deps: DataFrame, order: str) -> DataFrame:
    """The first of each (ecosystem, lower-cased name)."""
    return latest(deps.withColumn("__n", F.lower("name")), ["ecosystem", "__n"], [order]).drop("__n")


def component_kind(path: Column, capabilities: Column, dockerfiles: Column, has_compose: Column, library_hint: Column, nested: Column) -> Column:
    """What a component is; the first rule that holds counts."""
    parts = F.when(path == ".", F.array().cast("array<string>")).otherwise(F.split(F.lower(path), "/"))
    among = lambda a, names: F.arrays_overlap(a, F.array(*map(F.lit, names)))
    packaged = (dockerfiles > 0) | has_compose
    return (F.when(among(parts, TEST_SEGMENTS), "test").when(among(parts, EXAMPLE_SEGMENTS), "example").when((path == ".") & nested & (dockerfiles == 0), "library")
            .when(among(capabilities, SERVING), "api").when(F.array_contains(capabilities, "frontend"), "frontend").when(among(capabilities, WORK) & packaged, "worker")
            .when(F.array_contains(capabilities, "scheduled-jobs") & packaged, "cron").when(among(capabilities, MODEL) & packaged, "ml-service").when(packaged & ~library_hint, "worker")
            .when(library_hint | among(parts, LIBRARY_SEGMENTS), "library").otherwise("unknown"))


def deployable(kind: Column, packaged: Column) -> Column:
    return (kind == "frontend") | (kind.isin("api", "worker", "cron", "ml-service") & packaged)


def confident(rows: DataFrame, confidence: str) -> DataFrame:
    """Findings of enough confidence, with a ceiling on it."""
    return rows.where(F.col(confidence) >= LEAST_CONFIDENCE).withColumn(confidence, F.least(F.col(confidence), F.lit(MOST_CONFIDENCE)))


def verify(citations: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """id and verdict of citations: span_missing, span_changed, supported, unsupported.

    citations: id, claim, path, start_line, end_line, sha256. files: path, sha256 as file_sha. chunks: path, c_start, content. The
    cited lines are put together from chunks, later ones over earlier ones, missing lines empty.
    """
    sound = citations.where("start_line >= 1 and end_line >= start_line")
    met = sound.join(chunks, "path")
    lines = met.select("id", "start_line", "end_line", "c_start", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("k", "line"))
    lines = lines.withColumn("n", F.col("c_start") + F.col("k")).where("n between start_line and end_line")
    held = lines.groupBy("id", "start_line", "end_line", "n").agg(F.max_by("line", "c_start").alias("line"))
    spans = held.groupBy("id", "start_line", "end_line").agg(F.map_from_entries(F.collect_list(F.struct("n", "line"))).alias("m"))
    spans = spans.select("id", F.array_join(F.transform(F.sequence("start_line", "end_line"), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(""))), "\n").alias("span"))
    rows = citations.join(files, "path", "left").join(spans, "id", "left")
    verdict = F.when(F.col("file_sha").isNull() | F.col("span").isNull(), "span_missing").when(F.col("file_sha") != F.col("sha256"), "span_changed").when(text.term_in_span(F.col("claim"), F.col("span")), "supported").otherwise("unsupported")
    return rows.select("id", verdict.alias("verdict"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Counts by verdict and the share settled as supported, 0 if none was checked."""
    kinds = ["supported", "unsupported", "span_missing", "span_changed"]
    n = F.count("*")
    return verdicts.agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in kinds), F.when(n > 0, F.count_if(F.col("verdict") == "supported") / n).otherwise(0.0).alias("literal_share"))
