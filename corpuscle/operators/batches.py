"""Rows handed to Python in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows, and bytes, that Spark hands to Python at once: whole documents are long, and an executor holds a batch several times.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def in_batches(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` on batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes.

    Spark reads these limits when the plan runs, so they are lowered for the session and not for one call; limits of the
    session's own that are lower stay. They set how rows travel, no result.
    """
    conf = df.sparkSession.conf
    for name, most in ((_BATCH, BATCH_ROWS), (_BATCH_BYTES, BATCH_BYTES)):
        now = conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, most)
    return df.mapInArrow(of, schema)
