"""Summaries: reasons, exact quantiles, histograms, profiles and ratios, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scalars as S
from ..storage import cut
from . import ordered


def reason_counts(df: DataFrame, reason: str, passed: str = "passed") -> DataFrame:
    """Rows a reason, with each one's share of all rows and whether it is the passing one."""
    counts = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(reason, "n", (F.col("n") / F.col("total")).alias("share"), (F.col(reason) == passed).alias("is_pass"))


def numeric_summary(df: DataFrame, columns: list[str], empty_as_zero: bool = False) -> DataFrame:
    """A row a column: n, min, p25, p50, p75, max and mean, with interpolated exact quantiles; non-numbers and nulls are left out.

    Equal values are counted before the shuffle, and a quantile is found where the running count over the ordered values passes its
    place, so no task holds a column's values. Without values the statistics are null, or 0 with ``empty_as_zero``.
    """
    number = lambda c: F.col(c).try_cast("double") if isinstance(df.schema[c].dataType, StringType) else F.col(c).cast("double")
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in columns))).alias("x")).select("x.*")
    counts = cut(rows.filter("v is not null and not isnan(v)").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    totals = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    passed = ordered.running(counts, ["column"], [F.col("v")], F.col("n"), "upto").join(F.broadcast(totals.select("column", "rows")), "column")
    # Place q * (rows - 1), counted from 0, lies between two values, each the first one whose running count exceeds its own place.
    at = lambda q, side: side((F.col("rows") - 1) * F.lit(q))
    holds = lambda place: (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
    ends = {f"{name}_{side.__name__}": F.max(F.when(holds(at(q, side)), F.col("v"))) for name, q in _QUANTILES.items() for side in (F.floor, F.ceil)}
    found = passed.groupBy("column").agg(*(c.alias(n) for n, c in ends.items()))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = every.join(F.broadcast(totals), "column", "left").join(F.broadcast(found), "column", "left")
    part = lambda q: (F.col("rows") - 1) * F.lit(q) - F.floor((F.col("rows") - 1) * F.lit(q))
    between = {name: F.col(f"{name}_floor") + part(q) * (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) for name, q in _QUANTILES.items()}
    out = out.select("column", F.coalesce("rows", F.lit(0)).alias("n"), "min", *(c.alias(name) for name, c in between.items()), "max", "mean")
    return out.fillna(0.0, ["min", "p25", "p50", "p75", "max", "mean"]) if empty_as_zero else out


_QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def histogram(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and of distinct values of each column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_distinct(c).alias(f"distinct_{c}") for c in columns))


def ratios(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: each condition's share of all rows; 0 without rows. A null condition is not met."""
    return df.agg(*(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)).alias(name) for name, c in conditions.items()))


def counts_per_parent(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """One row: parents without children, and the mean and maximum number of children."""
    n = parents.select(key).distinct().join(children.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count_if(F.col("n") == 0).alias("without"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the ``mean`` of batch values weighted by their sizes, and the size of all; 0 without rows."""
    total = F.coalesce(F.sum(weight), F.lit(0))
    return df.agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.lit(0.0)).alias("mean"), total.alias("n"))


def most_common(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    """The ``top`` most frequent combinations with their counts, ties by value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(top)


def run_totals(windows: DataFrame, chosen: DataFrame, task: str = "task_id", score: str = "score", length: str = "peptide_length", most: int = 4, bands: list[tuple[float, str]] | None = None) -> DataFrame:
    """One row of totals and means of a sampling run: ``windows`` are all joined candidates (with ``duplicate``, ``eligible``, and columns
    ``burial``, ``pocket_size``, ``hit_left``, ``hit_right``), ``chosen`` those taken (with ``stage``: sampled or filled).
    """
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = windows.groupBy(task).agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("duplicate")).alias("dup"), F.count_if(F.col("eligible") & ~F.col("duplicate")).alias("fit"))
    kept = F.col("before") - F.col("dup")
    tasks = per.agg(
        F.count(F.lit(1)).alias("num_parent_tasks"), F.coalesce(F.sum("before"), F.lit(0)).alias("total_candidates_before"), F.coalesce(F.sum("dup"), F.lit(0)).alias("total_redundant_dropped"),
        F.coalesce(F.sum("fit"), F.lit(0)).alias("total_eligible_after_dedup"), F.count_if(kept > most).alias("tasks_truncated"), F.coalesce(F.sum(F.greatest(kept - F.lit(most), F.lit(0))), F.lit(0)).alias("total_topk_dropped"),
        F.count_if(F.col("fit") == 0).alias("tasks_with_no_eligible_pool"), F.count_if(F.col("fit") > most).alias("tasks_with_sampling_active"),
    )
    rows = windows.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score_before"), F.count("burial").alias("burial_present_count"), F.count("pocket_size").alias("pocket_size_present_count"))
    cut_ = bands or [(10, "8_10"), (14, "11_14")]
    labels = [name for _, name in cut_] + ["15_20"]
    after = chosen.agg(
        F.count(F.lit(1)).alias("total_candidates_after"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score_after"), F.count_if(F.col("stage") == "sampled").alias("total_sampled_from_eligible"),
        F.count_if(F.col("stage") == "filled").alias("total_filled_by_fallback"), F.count_if(F.col("hit_left") & F.col("hit_right")).alias("final_both_cap_count"),
        *(F.count_if(S.band(F.col(length), cut_, "15_20") == name).alias(f"length_{name}") for name in labels),
    )
    one = tasks.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(after))  # each side is one row
    return one.select(
        "*",
        share(F.col("total_candidates_before"), F.col("num_parent_tasks")).alias("avg_candidates_before"),
        share(F.col("total_candidates_after"), F.col("num_parent_tasks")).alias("avg_candidates_after"),
        share(F.col("burial_present_count"), F.col("total_candidates_before")).alias("burial_present_ratio"),
        share(F.col("pocket_size_present_count"), F.col("total_candidates_before")).alias("pocket_size_present_ratio"),
        share(F.col("final_both_cap_count"), F.col("total_candidates_after")).alias("final_both_cap_ratio"),
    )
