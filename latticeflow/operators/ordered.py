"""Ordered-group operators: ranks, quotas, caps, frames, runs and window enumeration.

Every order must be total (end it with an id), so results do not depend on the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import cut, join_checked, join_counted


def over(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1. Spark drops later rows of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(over(keys, order))).filter(F.col(rank) <= k)


def running(df: DataFrame, keys: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """The running sum of ``weight`` up to and with each row of its group, however large a group is.

    Rows are dealt by ranges of group and order, so a large group lies in many parts; sums are taken inside each part, and the sum of
    a group's earlier parts is added. A part begins inside one group at most, so what is added has a row a part, and is broadcast.
    """
    dealt = df.withColumn("__w", weight.cast("long"))
    dealt = cut(dealt.repartitionByRange(*(F.col(f"`{k}`") for k in keys), *order).withColumn("__part", F.spark_partition_id()), "dealt")
    local = dealt.withColumn(name, F.sum("__w").over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = dealt.groupBy("__part", *keys).agg(F.sum("__w").alias("__w"))
    before = F.sum("__w").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    added = sums.select(F.col("__part").alias("__later"), *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), before.alias("__before")).filter("__before is not null")
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__later"))
    whole = local.join(F.broadcast(added), same, "left").withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0)))
    return whole.select(*df.columns, name)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Each row's place in its group, from 1, as ``running``: for groups of any size of which all rows are wanted."""
    return running(df, keys, order, F.lit(1), name)


def first_of_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def with_share(df: DataFrame, keys: list[str], weight: Column, name: str) -> DataFrame:
    """Each row's share of its group's total weight; 0 in a group without weight. Totals are summed before the shuffle, and the rows
    of large groups are not shuffled to theirs. ``df`` is read three times: pass files."""
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("__total"), F.count(F.lit(1)).alias("__n"))
    totals = cut(totals, "totals")
    shared = join_counted(df, totals, keys, "inner", "__n", int(totals.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]))
    return shared.select(*df.columns, F.when(F.col("__total") > 0, weight / F.col("__total")).otherwise(F.lit(0.0)).alias(name))


def band_quota_backfill(df: DataFrame, keys: list[str], band: str, quotas: dict[str, int], order: list[Column], total: int, rank: str = "rank") -> DataFrame:
    """Up to each band's quota by order, then the best of the rest up to ``total``; ranked by order among the kept."""
    quota = F.coalesce(F.element_at(S.literal_map(quotas), F.col(band)), F.lit(0))
    first = df.withColumn("__in", F.row_number().over(over([*keys, band], order)) <= quota)
    filled = first.withColumn("__n", F.row_number().over(over(keys, [F.col("__in").desc(), *order]))).filter(F.col("__n") <= total)
    return filled.withColumn(rank, F.row_number().over(over(keys, order))).drop("__in", "__n")


def capped(df: DataFrame, keys: list[str], order: list[Column], cap: int, reason: str = "group_cap") -> DataFrame:
    """All rows with ``kept`` and, beyond the cap of the group, a ``drop_reason``."""
    placed = ranked(df, keys, order, "__n")
    return placed.withColumn("kept", F.col("__n") <= cap).withColumn("drop_reason", F.when(~F.col("kept"), F.lit(reason))).drop("__n")


def take_quota(df: DataFrame, quotas: DataFrame, keys: list[str], order: list[Column], quota: str = "quota") -> DataFrame:
    """The first rows of each group, as many as the group's quota in ``quotas`` (a row a group) says; none without one."""
    held = quotas.select(*keys, F.col(quota).alias("__quota"))
    return join_checked(ranked(df, keys, order, "__n"), held, keys, "inner", held.count()).filter("__n <= __quota").select(*df.columns)


def thin_to_quota(df: DataFrame, quotas: DataFrame, keys: list[str], protected: Column, order: list[Column], quota: str = "quota") -> DataFrame:
    """Thin each group to the larger of its quota and its number of protected rows, these first; a group without quota stays."""
    marked = df.withColumn("__p", F.coalesce(protected, F.lit(False)))
    held = quotas.select(*keys, F.col(quota).alias("__quota"))
    placed = ranked(marked, keys, [F.col("__p").desc(), *order], "__n")
    known = join_checked(placed, held, keys, "left", held.count())
    # Protected rows come first, so one beyond the quota is kept just because it is protected.
    return known.filter(F.col("__quota").isNull() | F.col("__p") | (F.col("__n") <= F.col("__quota"))).select(*df.columns)


def refill(donors: DataFrame, deficits: DataFrame, bin_: str, group: str, used: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    """Donors that fill the bins' deficits, bins in their ``bin_order``, without any group going over ``cap`` rows in all.

    ``used`` (group, n) says what groups have already. The bins, cells of a grid, are visited one after the other: of a bin's donors,
    a group's first ones up to the cap may go, and of these the first ones up to the deficit do.
    """
    short = sorted((r["bin_order"], r[bin_], r["deficit"]) for r in deficits.select(bin_, "bin_order", "deficit").filter("deficit > 0").collect())
    have, taken = cut(used.select(group, F.col("n").cast("long").alias("__used")), "used"), []
    for _, name, deficit in short:
        first = top_k(donors.filter(F.col(bin_) == F.lit(name)), [group], order, cap, "__in_group")
        free = join_checked(first, have, [group], "left", have.count()).filter(F.coalesce("__used", F.lit(0)) + F.col("__in_group") <= cap)
        chosen = cut(ranked(free, [], order, "__n").filter(F.col("__n") <= deficit).select(*donors.columns), "refilled")
        taken.append(chosen)
        now = have.unionByName(chosen.groupBy(group).agg(F.count(F.lit(1)).alias("__used")))
        have = cut(now.groupBy(group).agg(F.sum("__used").alias("__used")), "used")
    return reduce(DataFrame.unionByName, taken) if taken else donors.limit(0)


# Frames, prefix sums and runs


def local_frame(df: DataFrame, keys: list[str], order: list[Column], count: str, radius: int = 3) -> DataFrame:
    """Mean count, coverage and longest run of positive counts over the rows up to ``radius`` before and after."""
    frame = over(keys, order).rowsBetween(-radius, radius)
    values = F.collect_list(F.coalesce(F.col(count), F.lit(0))).over(frame)
    out = df.withColumn("local_avg", F.avg(F.coalesce(F.col(count), F.lit(0)).cast("double")).over(frame))
    out = out.withColumn("local_coverage", F.avg((F.coalesce(F.col(count), F.lit(0)) > 0).cast("double")).over(frame))
    return out.withColumn("local_run", longest_true(F.transform(values, lambda v: v > 0)))


def longest_true(flags: Column) -> Column:
    """The longest run of true in an array."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, flag: Column) -> Column:
        now = F.when(flag, acc["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(flags, zero, step, lambda acc: acc["best"])


def longest_run(df: DataFrame, keys: list[str], order: list[Column], flag: Column, name: str = "longest_run") -> DataFrame:
    """Per group, the longest run of consecutive rows with a true flag; 0 without any."""
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__i", F.row_number().over(over(keys, order)))
    island = F.col("__i") - F.row_number().over(over([*keys, "__f"], [F.col("__i")]))
    runs = rows.withColumn("__island", island).groupBy(*keys, "__f", "__island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__f"), F.col("n"))), F.lit(0)).cast("long").alias(name))


def with_prefix(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The running sum up to and with each row."""
    return df.withColumn(name, F.sum(value).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def with_breaks(df: DataFrame, keys: list[str], order: list[Column], linked: Column, name: str = "breaks") -> DataFrame:
    """The running number of breaks: a row whose predecessor exists and is not ``linked`` to it adds one.

    Rows i to j are continuous if, and only if, the numbers at i and j are equal.
    """
    first = F.row_number().over(over(keys, order)) == 1
    return df.withColumn("__b", F.when(first | F.coalesce(linked, F.lit(False)), 0).otherwise(1)).transform(lambda d: with_prefix(d, keys, order, F.col("__b"), name)).drop("__b")


def enumerate_windows(anchors: DataFrame, size: str, anchor: str, shortest: int, longest: int) -> DataFrame:
    """A row for each window ``left..right`` of each length that holds the anchor and stays in ``0..size - 1``."""
    lengths = anchors.withColumn("length", F.explode(F.sequence(F.lit(shortest), F.lit(longest))))
    low, high = F.greatest(F.lit(0), F.col(anchor) - F.col("length") + 1), F.least(F.col(anchor), F.col(size) - F.col("length"))
    lefts = lengths.filter(high >= low).withColumn("left", F.explode(F.sequence(low, high)))
    return lefts.withColumn("right", F.col("left") + F.col("length") - 1)


def neighbour_flags(df: DataFrame, keys: list[str], order: list[Column], linked: Column) -> DataFrame:
    """Whether a row has a predecessor and a successor that it is ``linked`` to (a condition on a row and its predecessor)."""
    w = over(keys, order)
    out = df.withColumn("linked_left", F.coalesce(linked, F.lit(False)) & (F.row_number().over(w) > 1))
    return out.withColumn("linked_right", F.coalesce(F.lead("linked_left").over(w), F.lit(False)))


def distinct_union(df: DataFrame, keys: list[str], order: list[Column], values: str) -> DataFrame:
    """Per key, the different elements of the arrays ``values`` of its rows, each where it comes first in ``order``."""
    placed = df.select(*keys, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("__o"), F.posexplode(values).alias("__i", "__v"))
    first = placed.groupBy(*keys, "__v").agg(F.min(F.struct("__o", "__i")).alias("__at"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__l"))
    return listed.select(*keys, F.transform("__l", lambda x: x["__v"]).alias(values))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
