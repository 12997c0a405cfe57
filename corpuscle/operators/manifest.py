"""Manifests of a file tree: selection, hashes, Merkle roots, diffs, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import text
from corpuscle.functions.hashing import skipped_hash

#: What is ignored besides a tree's own ignore files, and directories of foreign code.
DENIED = [".git/", "node_modules/", "target/", "dist/", "build/", ".next/", "vendor/", "__pycache__/", ".venv/", "*.min.js", "*.min.css", "*.map", "*.lock", "pnpm-lock.yaml", "package-lock.json", "poetry.lock", "Cargo.lock", "uv.lock"]
VENDORED = ["node_modules", "vendor", "bower_components", ".venv", "venv", "site-packages", "__pycache__", "dist", "build", "target", ".next", ".nuxt", ".git", "third_party"]
MAX_FILE_BYTES, PROBE_BYTES = 1 << 20, 8192


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns, in order, leave a path out: the last that matches decides, '!' takes back in.

    'x/' names a directory and all below it; a pattern with an inner or leading '/' counts from the root.
    """
    out = F.lit(False)
    for p in patterns:
        back, p = p.startswith("!"), p.removeprefix("!")
        folder, rooted = p.endswith("/"), "/" in p.rstrip("/")
        regex = text.glob_pattern(p.strip("/"))[:-1]
        regex = regex if not rooted else "^" + regex.removeprefix("^(?:.*/)?").removeprefix("^")
        hit = path.rlike(regex + ("/.*$" if folder else "(?:/.*)?$"))
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def binary(content: Column) -> Column:
    """Whether the first 8 KiB of a file hold a zero byte."""
    return F.contains(F.decode(F.substring(content.cast("binary"), 1, PROBE_BYTES), "ISO-8859-1"), F.lit("\x00"))  # a character a byte


def skip_reason(path: Column, size: Column, content: Column, patterns: list[str], link_outside: Column | None = None, unreadable: Column | None = None, most: int = MAX_FILE_BYTES) -> Column:
    """Why a file is skipped, the first reason that holds; null if it is taken."""
    no = F.lit(False)
    return (F.when(~path.rlike(r"^[^�]*$"), "NonUtf8Path").when(ignored(path, patterns), "Ignored").when(link_outside if link_outside is not None else no, "OutsideRoot")
            .when(size > most, "TooLarge").when(unreadable if unreadable is not None else no, "Unreadable").when(binary(content), "Binary"))


def vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDORED)))


def candidate_class(path: Column, manifests: list[str]) -> Column:
    """manifest, dockerfile or compose by file name; null for other files."""
    name = text.base_name(path)
    docker = name.rlike(r"^(?i)dockerfile(\..+)?$") | name.rlike(r"(?i)\.dockerfile$")
    return F.when(name.rlike(r"^(docker-)?compose(\.[\w-]+)?\.ya?ml$"), "compose").when(docker, "dockerfile").when(name.isin(manifests), "manifest")


def shallow_first(files: DataFrame, class_col: str, path_col: str, order_col: str, caps: dict[str, int]) -> DataFrame:
    """Of each class the files nearest the root, ties in given order, up to the class's cap."""
    order = Window.partitionBy(class_col).orderBy(F.size(F.split(path_col, "/")), order_col)
    cap = F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(class_col))
    return files.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def manifest(files: DataFrame, path_col: str, content_col: str, size_col: str) -> DataFrame:
    """path, size_bytes, sha256 of every file."""
    return files.select(F.col(path_col).alias("path"), F.col(size_col).alias("size_bytes"), F.sha2(content_col, 256).alias("sha256"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and state (added, removed, modified, unchanged) of two manifests with path and sha256."""
    a, b = old.select("path", F.col("sha256").alias("was")), new.select("path", F.col("sha256").alias("is"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def merkle(files: DataFrame, path_col: str = "path", hash_col: str = "sha256", reason_col: str | None = None) -> DataFrame:
    """path, kind (file, dir, skipped) and hash of every node up to the root, whose path is ''.

    A directory's hash is that of its children in byte order of their names: name, zero byte, kind, zero byte, hash,
    line feed. Levels are folded from the deepest up: one aggregate by parent a level.
    """
    kind = F.lit("file") if reason_col is None else F.when(F.col(reason_col).isNull(), "file").otherwise("skipped")
    digest = F.col(hash_col) if reason_col is None else F.coalesce(skipped_hash(F.col(reason_col)), F.col(hash_col))
    level = files.select(F.col(path_col).alias("path"), kind.alias("kind"), digest.alias("hash")).withColumn("depth", F.size(F.split("path", "/")))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    done, open_ = [], level.where("false")
    for depth in range(deepest, 0, -1):
        here = level.where(F.col("depth") == depth).unionByName(open_)
        done.append(here)
        part = F.concat(text.base_name(F.col("path")), F.char(F.lit(0)), F.substring("kind", 1, 1), F.char(F.lit(0)), F.col("hash"), F.lit("\n"))
        parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        folded = F.array_sort(F.collect_list(F.struct(text.base_name(F.col("path")).alias("n"), part.alias("p"))))
        joined = F.sha2(F.array_join(F.transform(folded, lambda x: x["p"]), ""), 256)
        open_ = here.groupBy(parent.alias("path")).agg(joined.alias("hash")).select("path", F.lit("dir").alias("kind"), "hash", F.lit(depth - 1).alias("depth"))
    done.append(open_)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("path", "kind", "hash")


def counters(files: DataFrame, reason: Column, size_col: str) -> DataFrame:
    """Files taken and skipped, bytes taken, in one row."""
    return files.agg(F.count_if(reason.isNull()).alias("files_taken"), F.count_if(reason.isNotNull()).alias("files_skipped"), F.coalesce(F.sum(F.when(reason.isNull(), F.col(size_col))), F.lit(0)).alias("bytes_taken"))


def shares(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """key, total and share of all, the largest first; nothing if all is zero."""
    sums = rows.groupBy(key).agg(F.sum(amount).alias("total"))
    whole = sums.agg(F.sum("total").alias("whole"))
    return sums.join(F.broadcast(whole)).where("whole > 0").select(key, "total", (F.col("total") / F.col("whole")).alias("share")).orderBy(F.desc("total"), key)
