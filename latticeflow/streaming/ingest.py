"""Ingestion of new files only, and stages that are skipped when their output is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest_new(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, format_: str = "json") -> None:
    """Append what is new in ``folder`` since the last call to a Parquet table, once each, and stop."""
    stream = transform(spark.readStream.schema(schema).format(format_).load(folder))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def done(spark: SparkSession, path: str) -> bool:
    """Whether a stage has published its output completely."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], folder: str, resume: str | None = None, force: str | None = None) -> dict[str, DataFrame]:
    """Run named stages in order, each over the outputs so far, and publish each as Parquet.

    Stages before ``resume`` are read, not run; from ``force`` on all are run anew; else a published output is reused.
    """
    names = [n for n, _ in stages]
    for given in (resume, force):
        if given is not None and given not in names:
            raise ValueError(f"no stage is called {given}")
    first, anew = names.index(resume) if resume else 0, names.index(force) if force else len(names)
    out: dict[str, DataFrame] = {}
    for i, (name, stage) in enumerate(stages):
        path = f"{folder}/{name}"
        if i < first and not done(spark, path):
            raise ValueError(f"{name} has no output to resume from")
        if i >= first and (i >= anew or not done(spark, path)):
            stage(out).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out
