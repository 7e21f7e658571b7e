"""Greedy selection: visit rows by priority and keep each one that conflicts with no row kept before.

The result is the lexicographically first maximal independent set of the conflict graph. All rows without an undecided or kept
neighbour of higher priority are kept at once, all rows next to a kept one of higher priority are dropped at once; the number of
rounds is the length of the longest alternating chain of priorities, not the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, join_counted, join_shuffled


def independent_set(rows: DataFrame, conflicts: DataFrame, key: str = "id", priority: str = "priority") -> DataFrame:
    """``rows`` (key, priority; lower comes first, nulls last, ties by key) and ``conflicts`` (a, b), read as undirected.

    Returns (key, kept, by): ``by`` is the kept neighbour of first priority for a dropped row. Only rows with a conflict take part
    in the rounds, and decided ones leave.
    """
    first = rows.select(F.col(key).alias("k"), F.struct(F.col(priority).isNull().alias("none"), F.col(priority).alias("p"), F.col(key).alias("k")).alias("o"))
    pairs = conflicts.select("a", "b").filter("a <> b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # Directed from a row to its neighbours of higher priority.
    edges = join_shuffled(join_shuffled(pairs, first.select(F.col("k").alias("a"), F.col("o").alias("oa")), "a"), first.select(F.col("k").alias("b"), F.col("o").alias("ob")), "b")
    every = edges = cut(edges.filter("ob < oa"), "conflicts")
    open_ = cut(edges.select(F.col("a").alias("k"), F.col("oa").alias("o")).unionByName(edges.select(F.col("b").alias("k"), F.col("ob").alias("o"))).distinct(), "open")
    rounds: list[DataFrame] = []
    while not open_.isEmpty():
        now = cut(join_shuffled(open_, edges.select(F.col("a").alias("k")).distinct(), "k", "left_anti"), "kept")
        dropped = cut(join_shuffled(edges, now.select(F.col("k").alias("b")), "b", "left_semi").select(F.col("a").alias("k")).distinct(), "dropped")
        rounds.append(now)
        gone = now.select("k").unionByName(dropped)
        open_ = cut(join_shuffled(open_, gone, "k", "left_anti"), "open")
        edges = cut(join_shuffled(join_shuffled(edges, gone.select(F.col("k").alias("a")), "a", "left_anti"), gone.select(F.col("k").alias("b")), "b", "left_anti"), "conflicts")
    if not rounds:
        return rows.select(key, F.lit(True).alias("kept"), F.lit(None).cast(rows.schema[key].dataType).alias("by"))
    kept = reduce(DataFrame.unionByName, rounds)
    best = join_shuffled(every, kept.select(F.col("k").alias("b")), "b", "left_semi").groupBy("a").agg(F.min("ob").alias("m")).select(F.col("a").alias(key), F.col("m.k").alias("by"))
    out = join_shuffled(join_shuffled(rows.select(key), best, key, "left"), kept.select(F.col("k").alias(key), F.lit(True).alias("__kept")), key, "left")
    return out.select(key, (F.col("__kept").isNotNull() | F.col("by").isNull()).alias("kept"), F.when(F.col("__kept").isNull(), F.col("by")).alias("by"))


def independent_set_of_copies(rows: DataFrame, conflicts: DataFrame, key: str = "id", priority: str = "priority", of: str = "class") -> DataFrame:
    """``independent_set`` where rows of one class conflict with each other and with all rows of the classes that ``conflicts`` (a, b)
    pairs theirs with; a row of a null class conflicts with none.

    A class's first row stands for it: if it is kept, it drops the others, and what drops it drops them too. So the rounds see a row a
    class, and copies give no pairs.
    """
    order = F.struct(F.col(priority).isNull().alias("none"), F.col(priority).alias("p"), F.col(key).alias("k"))
    firsts = cut(rows.filter(F.col(of).isNotNull()).groupBy(F.col(of).alias("c")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    chosen = independent_set(firsts, conflicts, "c", "first")
    named = join_shuffled(join_shuffled(chosen, firsts, "c"), firsts.select(F.col("c").alias("by"), F.col("first.k").alias("__by")), "by", "left")
    named = cut(named.select(F.col("c").alias(of), F.col("first.k").alias("__first"), F.col("kept").alias("__kept"), F.coalesce("__by", "first.k").alias("__over"), "n"), "chosen")
    total = int(named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = join_counted(rows.select(key, of), named, [of], "inner", "n", total)
    met = met.withColumn("kept", F.col("__kept") & (F.col(key) == F.col("__first"))).select(key, "kept", F.when(~F.col("kept"), F.col("__over")).alias("by"))
    free = rows.filter(F.col(of).isNull()).select(key, F.lit(True).alias("kept"), F.lit(None).cast(rows.schema[key].dataType).alias("by"))
    return met.unionByName(free)


def spaced_positions(df: DataFrame, keys: list[str], position: str, order: list[str], gap: int, most: int) -> DataFrame:
    """One-dimensional suppression inside each group: by order, keep positions more than ``gap`` away from all kept, at most ``most``.

    A group is one molecule or one user; its rows are visited in one Python call. ``order`` names columns to sort by, ``-`` first
    for descending; end it with the position.
    """
    names = [c.lstrip("-") for c in order]
    schema = df.schema

    def visit(pdf):
        pdf = pdf.sort_values(names, ascending=[not c.startswith("-") for c in order], kind="stable")
        kept, index = [], []
        for i, p in zip(pdf.index, pdf[position]):
            if len(kept) >= most:
                break
            if all(abs(p - q) > gap for q in kept):
                kept.append(p)
                index.append(i)
        out = pdf.loc[index].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.groupBy(*keys).applyInPandas(visit, f"{fields}, rank int")
