"""Matching a generated set to a reference distribution: joint densities over a grid, apportionment, and quota selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, join_checked
from . import ordered


def full_grid(df: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """All combinations of the axes' labels: a few dozen rows, made without looking at data."""
    spark = df.sparkSession
    columns = [F.explode(F.array(*(F.lit(x) for x in labels))).alias(axis) for axis, labels in axes.items()]
    return reduce(lambda d, c: d.select("*", c), columns, spark.range(1)).drop("id")


def grid_density(generated: DataFrame, reference: DataFrame, axes: dict[str, list[str]], epsilon_ref: float = 1e-6, epsilon_gen: float = 1e-5) -> DataFrame:
    """Per cell of the grid: counts and shares of both sets, the ratio of shares, and weights from it.

    Cells that the reference lacks get ``epsilon_ref``, then its shares are normalised again; ``weight`` is ``log1p(ratio)`` over its
    maximum. The grid's cells without rows are kept.
    """
    keys = list(axes)
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    cells = full_grid(generated, axes).join(side(generated, "count_gen"), keys, "left").join(side(reference, "count_ref"), keys, "left")
    cells = cells.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("count_gen", "count_ref")})
    everything = Window.partitionBy()
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(everything), F.lit(0)), F.lit(0.0))
    cells = cells.withColumn("p_gen", share("count_gen")).withColumn("raw", F.when(F.col("count_ref") > 0, share("count_ref")).otherwise(F.lit(epsilon_ref)))
    cells = cells.withColumn("p_ref", F.col("raw") / F.sum("raw").over(everything)).drop("raw")
    cells = cells.withColumn("density_ratio", F.col("p_ref") / (F.col("p_gen") + F.lit(epsilon_gen))).withColumn("log_ratio", F.log1p("density_ratio"))
    return cells.withColumn("weight", F.col("log_ratio") / F.max("log_ratio").over(everything))


def apportioned(shares: DataFrame, share: str, total: Column, tie: list[str], name: str = "quota") -> DataFrame:
    """Largest remainders: ``floor`` of each share's part of ``total``, and one more for the largest remainders, ties by ``tie``.

    The quotas sum to ``total``. ``shares`` holds one row a cell.
    """
    everything = Window.partitionBy()
    part = shares.withColumn("__raw", F.col(share) / F.sum(share).over(everything) * total)
    part = part.withColumn("__floor", F.floor("__raw")).withColumn("__need", total - F.sum("__floor").over(everything))
    rank = F.row_number().over(Window.partitionBy().orderBy((F.col("__raw") - F.col("__floor")).desc(), *tie))
    return part.withColumn(name, (F.col("__floor") + F.when(rank <= F.col("__need"), 1).otherwise(0)).cast("long")).drop("__raw", "__floor", "__need")


def quota_keep(df: DataFrame, quotas: DataFrame, cells: list[str], groups: list[str], order: list[Column], target: int) -> DataFrame:
    """Three stages: the first row of each group (the floor), each cell's quota, then the best of the rest up to ``target`` rows.

    The target is raised to the size of the floor. Adds ``keep_stage``: floor, quota or fill.
    """
    heads = ordered.first_of_group(df.select(*df.columns), groups, order).withColumn("__floor", F.lit(True))
    marked = df.withColumn("__floor", F.lit(False)).exceptAll(heads.withColumn("__floor", F.lit(False))).unionByName(heads)
    held = cut(quotas.select(*cells, "quota"), "quotas")
    floors = heads.groupBy(*cells).agg(F.count(F.lit(1)).alias("__floors"))
    bounds = cut(held.join(floors, cells, "left").select(*cells, F.greatest(F.lit(0), F.coalesce("quota", F.lit(0)) - F.coalesce("__floors", F.lit(0))).alias("__room")), "bounds")
    placed = ordered.ranked(marked, [*cells, "__floor"], order, "__n")
    staged = join_checked(placed, bounds, cells, "left", bounds.count())
    staged = staged.withColumn("keep_stage", F.when(F.col("__floor"), "floor").when(F.col("__n") <= F.coalesce("__room", F.lit(0)), "quota")).select(*df.columns, "keep_stage")
    staged = cut(staged, "staged")
    kept = staged.filter("keep_stage is not null")
    more = max(0, target - kept.count())
    rest = ordered.ranked(staged.filter("keep_stage is null"), [], order, "__n").filter(F.col("__n") <= more)
    return kept.unionByName(rest.withColumn("keep_stage", F.lit("fill")).select(*kept.columns))
