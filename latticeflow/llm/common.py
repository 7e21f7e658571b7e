"""What the operators of this subpackage share beside the library's lineage cuts and checked joins."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, join_checked, join_counted

__all__ = ["cut", "held_out", "join_checked", "join_counted", "remainder", "small_batches", "table", "trim"]

#: Rows and bytes of a batch that goes to a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; smaller bounds that it has already stay.

    Texts are long: the usual 10,000 rows are tens of megabytes, held several times over by the executor and its workers.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key, None) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Hand freed memory back to the system, where the C library can: after large arrays its allocator keeps tens of megabytes."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; null for a null key."""
    return F.crc32(key.cast("string")) % F.lit(by)


def held_out(key: Column, by: int, rest: int) -> Column:
    """Whether a row is kept from learning; a null key is not held out, but matches no label either."""
    return F.coalesce(remainder(key, by) == F.lit(rest), F.lit(False))
