"""File trees, JSON snapshots and remote listings as tables; tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle.operators.relational import repeated_keys, upsert

RATE = "serviceId string, region string, sku string, usageType string, unit string, usd double, attributes map<string,string>"


def scan_tree(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """path below the root, size_bytes, modified, content of all files. A size cap reaches the file source."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows if most is None else rows.where(F.col("length") <= most)
    base = root.rstrip("/").removeprefix("file:")
    below = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(F.substring(below, F.lit(len(base) + 2), F.length(below)).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def blob_text(content):
    """Text of a base64 blob."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str = RATE) -> DataFrame:
    """Gzipped JSON lines with a fixed schema; malformed lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_header(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A few fields of the first record: column pruning and a limit reach the scan."""
    return spark.read.schema(fields).option("multiLine", "true").json(path).limit(1)


def subtree(offers: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """Entries of a map column as rows."""
    return offers.select(*(c for c in offers.columns if c != column), F.explode(F.col(column)).alias(key, value))


def rate_table(spark: SparkSession, nested: dict[str, dict[str, dict[str, float]]]) -> DataFrame:
    """engine, class, deployment, hour_usd of a nested rate table, a dimension."""
    rows = [(e, c, d, float(x)) for e, by in nested.items() for c, deployments in by.items() for d, x in deployments.items()]
    return spark.createDataFrame(rows, "engine string, class string, deployment string, hour_usd double")


def append_run(df: DataFrame, path: str, run_col: str = "run_id") -> None:
    """Appends rows partitioned by run, so that readers of finished runs never see a half-written one."""
    df.write.mode("append").partitionBy(run_col).parquet(path)


def insert_unique(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows; repeated keys among them fail the whole insert before anything is written."""
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"repeated {', '.join(keys)}")
    df.write.mode("append").parquet(path)


def replace_keys(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: str, to: str) -> None:
    """Writes the table at ``path`` after an upsert to ``to``."""
    upsert(spark.read.parquet(path), changes, keys, order).write.mode("overwrite").parquet(to)


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, owner: str, user: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without what a user's delete of one name takes along."""
    gone = parents.where((F.col(owner) == user) & (F.col(key) == name)).select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def carry_forward(old: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of an earlier run whose file (path, sha256) is unchanged in a new manifest."""
    return old.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_semi")
