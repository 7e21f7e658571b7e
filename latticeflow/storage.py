"""Lineage cuts in the folder that driver and executors share, and joins whose broadcasts are checked by size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast, at no more than a few hundred bytes a row.
BROADCAST_ROWS = 400_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster sets it.

    Where the setting is absent, as in tests, a temporary folder serves if, and only if, everything runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="latticeflow-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The plan above starts from files that survive the loss of any executor, and no later step computes ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(since: int = 0) -> None:
    """Delete the files of the cuts made after the first ``since`` ones; only once nothing reads them any more."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and with it the folder's owner
            pass


atexit.register(drop_cuts)


def publish(df: DataFrame, name: str, since: int) -> DataFrame:
    """``cut``, after which the files of the cuts from number ``since`` on, which only led up to it, are deleted."""
    out = cut(df, name)
    last = _written.pop()
    drop_cuts(since)
    _written.append(last)
    return out


def cuts_made() -> int:
    """How many cuts there are: the mark that ``publish`` and ``drop_cuts`` take."""
    return len(_written)


def with_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df``, after the session's batches for Python workers were bounded to ``size`` bytes where they are larger."""
    conf = df.sparkSession.conf
    most = (conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) or "").removesuffix("b")
    if not most.isdigit() or not 0 < int(most) <= size:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a right side of ``rows`` rows: broadcast up to ``most``, beyond that hashed after a shuffle, without a sort."""
    return left.join(F.broadcast(right) if rows <= most else right.hint("shuffle_hash"), on, how)


def join_shuffled(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Join in which neither side is ever broadcast: both are shuffled and sorted, which spills and lets hot keys be split.

    For sides whose rows nobody has counted. Spark's estimate goes by the size of compressed files and knows nothing of what an
    explode adds, so it would collect hundreds of MB in the driver for a few MB of Parquet.
    """
    return left.join(right.hint("merge"), on, how)


#: Keys with more than one in so many of all rows are hot: there can be no more of them than this.
HOT_KEYS = 100_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str, count: str, rows: int) -> DataFrame:
    """Join with a right side of one row a key whose ``count`` is how many of the ``rows`` rows of ``left`` have the key.

    Keys with over ``rows / HOT_KEYS`` rows, HOT_KEYS of them at most, are broadcast and their rows are not shuffled; the rows of
    all other keys meet in a hash join after a shuffle, where a key brings a hundred-thousandth of the rows at most. ``how`` is
    inner or left_semi; ``left`` is read once for each of the two. ``count`` is no column of the result.
    """
    bound = max(1, rows // HOT_KEYS)
    hot, rest = right.filter(F.col(count) > bound).drop(count), right.filter(F.col(count) <= bound).drop(count)
    flagged = left.join(F.broadcast(hot.select(*on, F.lit(True).alias("__hot"))), on, "left")
    first = left.join(F.broadcast(hot), on, how)
    second = flagged.filter("__hot is null").drop("__hot").join(rest.hint("shuffle_hash"), on, how)
    return first.select(*second.columns).unionByName(second)
