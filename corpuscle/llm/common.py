"""Helpers that the corpus operators share: reading tables, shared folders, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.operators.batches import BATCH_BYTES, BATCH_ROWS, in_batches  # noqa: F401

_CHECKPOINT = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
    machine, a temporary folder is made and kept for the rest of the application.
    """
    named = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpuscle-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    The plan above it starts from files that outlive any executor, and nothing below it runs twice.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept_path(df: DataFrame) -> str:
    """Folder of a table that ``keep`` has written."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def crc32_mod(column: str, modulus: int):
    """crc32 of a key written as text, modulo a number; null keys count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def smallest_hashes(rows: DataFrame, group: list[str], key: str, most: int) -> DataFrame:
    """Of each group the ``most`` rows with the smallest hashes of their key: a sample that any run draws alike.

    Rows far beyond the bound are left out by their hash before anything is sorted, at twice the share that the group's
    size calls for; what is ranked is then about twice ``most`` rows a group, whatever the group's size.
    """
    # stored, so that Spark knows how small it is and does not shuffle the rows to meet it
    sizes = keep(rows.groupBy(*group).agg(F.count("*").alias("__n")), "sizes")
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    share = F.pmod(F.xxhash64(F.lit(7), F.col(f"a.{key}")), F.lit(1 << 30)) / float(1 << 30)
    near = rows.alias("a").join(sizes.alias("b"), same).where(share * F.col("__n") <= 2.0 * most + 20).select("a.*", share.alias("__u"))
    order = Window.partitionBy(*group).orderBy("__u", key)
    return near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__u").withColumnRenamed("__r", "place")
