"""Splitting documents into chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import declarations
from corpuscle.operators.batches import BATCH_BYTES, BATCH_ROWS, in_batches


_TOKEN = re.compile(r"\w+|[^\w\s]")


def _count(s: str) -> int:
    return len(_TOKEN.findall(s))


def line_windows(docs: DataFrame, id_col: str, text_col: str, lines: int, overlap: int = 0) -> DataFrame:
    """Windows of a fixed number of lines: id column, start_line, end_line, content."""
    rows = F.split(F.col(text_col), "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size("__l") - 1, F.lit(0)), F.lit(lines - overlap))
    cut = docs.select(F.col(id_col), rows.alias("__l")).where("__l is not null").select(id_col, "__l", F.explode(starts).alias("s"))
    end = F.least(F.col("s") + lines, F.size("__l"))
    return cut.select(id_col, (F.col("s") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("__l", F.col("s") + 1, end - F.col("s")), "\n").alias("content"))


def _greedy(text: str, most: int, first: int = 1) -> Iterator[tuple[int, int, str, int]]:
    """Lines gathered while they stay within the budget; a longer line is cut into pieces, none of it lost."""
    if text and (whole := _count(text)) <= most:  # no token spans a line's end
        yield first, first + text.count("\n") - text.endswith("\n"), text, whole
        return
    held, start, tokens = [], first, 0
    for k, line in enumerate(text.splitlines(keepends=True), first):
        n = _count(line)
        if held and tokens + n > most:
            yield start, k - 1, "".join(held), tokens
            held, start, tokens = [], k, 0
        if n > most:
            ends = [m.end() for m in _TOKEN.finditer(line)]
            at = 0
            for i in range(most - 1, len(ends) + most - 1, most):
                end = ends[i] if i < len(ends) - 1 else len(line)
                yield k, k, line[at:end], _count(line[at:end])
                at = end
            start = k + 1
            continue
        if not held:
            start = k
        held.append(line)
        tokens += n
    if held:
        yield start, first + text.count("\n") if not text.endswith("\n") else first + text.count("\n") - 1, "".join(held), tokens


def token_chunks(docs: DataFrame, id_col: str, text_col: str, max_tokens: int = 512) -> DataFrame:
    """Greedy line chunks within a token budget: id, start_line, end_line, content, token_count.

    The next chunk's start depends on the last one's length, so each document is walked by itself; documents spread
    over tasks as they lie, without a shuffle. Null and empty texts give no chunk.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = ((k, *c) for k, t in enumerate(b.column(1).to_pylist()) if t for c in _greedy(t, max_tokens))
            yield from _tables(b.column(0), chunks, 2, types, [id_col, "start_line", "end_line", "content", "token_count"])

    return in_batches(docs.select(id_col, text_col), cut, f"{id_col} {kind}, start_line int, end_line int, content string, token_count int")


def _tables(ids: pa.Array, rows: Iterable[tuple], content: int, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows, their first field the place of their id, as batches of a bounded number of rows and bytes."""
    types, held, size = [pa.int64(), *types], [], 0

    def out() -> pa.RecordBatch:
        place, *rest = (pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(place), *rest], names)

    for r in rows:
        held.append(r)
        size += len(r[content + 1])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _python_spans(source: str) -> list[tuple[int, int, str | None, str]]:
    tree = ast.parse(source)
    spans: list[tuple[int, int, str | None, str]] = []
    for node in tree.body:
        start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            if spans and spans[-1][3] == "imports" and spans[-1][1] + 1 >= start:
                spans[-1] = (spans[-1][0], node.end_lineno, None, "imports")
            else:
                spans.append((start, node.end_lineno, None, "imports"))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            spans.append((start, node.end_lineno, node.name, "function"))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            first = min((min([m.lineno, *(d.lineno for d in m.decorator_list)]) for m in methods), default=node.end_lineno + 1)
            spans.append((start, first - 1, node.name, "class"))
            for m in methods:
                spans.append((min([m.lineno, *(d.lineno for d in m.decorator_list)]), m.end_lineno, f"{node.name}.{m.name}", "method"))
    return sorted(spans, key=lambda s: s[:2])


def _declared_chunks(source: str, language: str, most: int) -> Iterator[tuple]:
    """Chunks along declarations, the lines between them by windows; windows alone if the file cannot be made out."""
    try:
        spans = _python_spans(source) if language == "python" else declarations.spans(source, language)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last is the parser's own depth limit
        spans = []
    # lines as the parser counts them
    lines, at = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+" if language == "python" else r"[^\n]*\n|[^\n]+", source), 1
    for start, end, symbol, kind in [*spans, (len(lines) + 1, len(lines), None, "")]:
        between = "".join(lines[at - 1 : start - 1])
        if between.strip():
            for s, e, c, n in _greedy(between, most, at):
                yield s, e, None, "line_window", c, n
        if kind:
            for s, e, c, n in _greedy("".join(lines[start - 1 : end]), most, start):
                yield s, e, symbol, kind, c, n
        at = max(at, end + 1)


def source_chunks(files: DataFrame, id_col: str, text_col: str, language_col: str, max_tokens: int = 512) -> DataFrame:
    """Chunks of source files: Python, TypeScript, JavaScript, Go and Rust by declarations, the rest by lines.

    id, start_line, end_line, symbol, kind, content, token_count. Lines outside declarations become ``line_window`` chunks,
    so that nothing but blank lines is lost; so does a file that does not parse or whose brackets do not pair. A file is one
    row's work, linear in its length.
    """
    kind = files.schema[id_col].dataType.simpleString()
    names = [id_col, "start_line", "end_line", "symbol", "kind", "content", "token_count"]

    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def of(texts: list[str | None], languages: list[str | None]) -> Iterator[tuple]:
        for k, (t, lang) in enumerate(zip(texts, languages, strict=True)):
            if t and (lang == "python" or lang in declarations.LANGUAGES):
                yield from ((k, *c) for c in _declared_chunks(t, lang, max_tokens))
            elif t:
                yield from ((k, s, e, None, "line_window", c, n) for s, e, c, n in _greedy(t, max_tokens))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _tables(b.column(0), of(b.column(1).to_pylist(), b.column(2).to_pylist()), 4, types, names)

    return in_batches(files.select(id_col, text_col, language_col), cut, f"{id_col} {kind}, start_line int, end_line int, symbol string, kind string, content string, token_count int")


def merge_small(chunks: DataFrame, group: str, order: str, parent: str, content: str, tokens: str, least: int, most: int) -> DataFrame:
    """Joins each chunk below ``least`` tokens with the siblings that follow, up to ``most`` tokens.

    Siblings share a non-null ``parent``. Where a merge ends depends on the ones before, so a file's chunks are one row's
    work, files many to a batch; a file is bounded by the size cap of the scan. A chunk's tokens are counted once.
    """

    def fold(rows: list[dict]) -> Iterator[dict]:
        rows.sort(key=lambda r: (r[order] is None, r[order] if r[order] is not None else 0))
        k = 0
        while k < len(rows):
            now, n, held = rows[k], None, []
            while now[tokens] is not None and now[tokens] < least and k + 1 < len(rows):
                after = rows[k + 1]
                if now[parent] is None or now[parent] != after[parent]:
                    break
                # no token spans the line end between two chunks
                n = (_count(now[content]) if n is None else n) + _count(after[content])
                if n > most:
                    break
                held = held or [now[content]]
                held[-1] = held[-1].rstrip()
                if not held[-1]:
                    held = ["\n".join(held).rstrip()]
                held.append(after[content])
                now[tokens] = n
                k += 1
            if held:
                now[content] = "\n".join(held)
            yield now
            k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = pa.schema(list(b.schema.field(0).type.value_type))
            for rows in b.column(0):
                yield pa.RecordBatch.from_pylist(list(fold(rows.as_py())), schema=fields)

    gathered = chunks.groupBy(F.col(group).alias("__g")).agg(F.collect_list(F.struct(*chunks.columns)).alias("__rows"))
    return in_batches(gathered.select("__rows"), run, chunks.schema)


def hashing_embedding(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """A deterministic embedding without a model: signed word counts hashed to ``dim`` places, scaled to length 1."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\W+"), lambda w: w != "")
    rows = docs.select(id_col, F.explode_outer(words).alias("w"))
    place, sign = F.pmod(F.xxhash64("w"), F.lit(dim)), F.when(F.pmod(F.hash("w"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    counts = rows.groupBy(id_col, place.alias("p")).agg(F.sum(sign).alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")))
    filled = F.map_from_entries(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "v"))))
    out = counts.groupBy(id_col).agg(filled.alias("m"), length.alias("n"))
    return out.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.when(F.col("n") > 0, F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0.0)) / F.col("n")).otherwise(0.0)).alias("embedding"))
