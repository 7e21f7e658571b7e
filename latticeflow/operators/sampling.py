"""Weights, weighted samples without replacement, and splits; all decided by hashes of ids, not by the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, join_checked
from . import ordered


def hash_order(key: Column, seed: str = "") -> Column:
    """A pseudo-random but fixed order: the md5 of the seed and the key as text."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def uniform(key: Column, seed: str = "") -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of the md5."""
    return (F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def coverage_weight(coverage: Column, threshold: float = 0.5) -> Column:
    """What exceeds the threshold, or the coverage itself if nothing does; 0.001 at least. It jumps at the threshold, as specified."""
    return F.greatest(F.lit(1e-3), F.when(coverage > threshold, coverage - threshold).otherwise(coverage))


def length_bonus_weight(weight: Column, length: Column, power: float = 1.0, strength: float = 0.0, base: int = 8) -> Column:
    return F.pow(weight, F.lit(power)) * F.pow(length / F.lit(base), F.lit(strength))


def weighted_sample(df: DataFrame, keys: list[str], weight: Column, key: Column, k: int, seed: str = "") -> DataFrame:
    """Up to k rows a group, without replacement, with chances by weight: the largest keys ``ln(u) / w``. The sample is the feature."""
    w = F.greatest(weight, F.lit(1e-6))
    drawn = df.withColumn("__es", F.log(uniform(key, seed)) / w)
    return ordered.top_k(drawn, keys, [F.col("__es").desc(), key], k, "pick").drop("__es")


def seeded_sample(df: DataFrame, group: str, weight: str, length: str, order: list[str], k: int = 4, short: int = 8, most_short: int = 2, seed: int = 20260416) -> DataFrame:
    """Sequential draws with Python's seeded generator, one group at a time, in the group's ``order``.

    The seed adds the sum of the group id's code points. A group of k rows or fewer is kept whole. Once ``most_short`` rows of
    length ``short`` are drawn, only others are drawn while any are left. A group is one task's few windows.
    """
    fields = df.schema

    def draw(pdf):
        import random

        pdf = pdf.sort_values(order, kind="stable") if order else pdf
        if len(pdf) <= k:
            return pdf.assign(pick=range(1, len(pdf) + 1))
        rng = random.Random(seed + sum(map(ord, str(pdf[group].iloc[0]))))
        pool, picked, shorts = list(range(len(pdf))), [], 0
        weights, lengths = [max(1e-6, float(w)) for w in pdf[weight]], list(pdf[length])
        while pool and len(picked) < k:
            others = [i for i in pool if lengths[i] != short]
            among = others if shorts >= most_short and others else pool
            one = rng.choices(among, weights=[weights[i] for i in among], k=1)[0]
            shorts += lengths[one] == short
            picked.append(one)
            pool.remove(one)
        return pdf.iloc[picked].assign(pick=range(1, len(picked) + 1))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.groupBy(group).applyInPandas(draw, f"{names}, pick int")


def row_split(df: DataFrame, key: Column, share: float, seed: str = "", names: tuple[str, str] = ("monitor", "main_train")) -> DataFrame:
    """``split``: the rows with the smallest hashes, a ``share`` of all rounded half to even, against the rest.

    The cut is the exact order statistic of the hash, found by counting prefixes, four digits a scan, so no task sorts all rows.
    Rows of one key are not told apart and stay together.
    """
    hashed = df.withColumn("__h", hash_order(key, seed))
    n = round(hashed.count() * share)
    prefix = bound = ""
    while n and len(prefix) < 32:
        counts = hashed.filter(F.col("__h").startswith(prefix)).groupBy(F.substring("__h", len(prefix) + 1, 4).alias("d")).count().collect()
        for digits, rows in sorted((r["d"], r["count"]) for r in counts):
            if rows > n:
                prefix = bound = prefix + digits
                break
            n -= rows
        else:
            bound = prefix + "g"
            break
        if not n:
            break
    return hashed.withColumn("split", F.when(F.col("__h") < F.lit(bound), names[0]).otherwise(names[1])).drop("__h")


def group_split(df: DataFrame, group: str, cell: str, share: float, seed: str = "", names: tuple[str, str] = ("monitor", "main_train")) -> DataFrame:
    """``split`` by whole groups, stratified by the groups' cells: in each cell ``max(1, round(n * share))`` groups by hash.

    A group's cell is that of its representative, the least cell by name, so no group is in both parts.
    """
    reps = df.groupBy(group).agg(F.min(cell).alias("__cell"))
    reps = cut(reps, "representatives")
    sizes = reps.groupBy("__cell").agg(F.count(F.lit(1)).alias("__size"))
    placed = ordered.ranked(reps, ["__cell"], [hash_order(F.col(group), seed), F.col(group)], "__n")
    placed = join_checked(placed, sizes, ["__cell"], "inner", sizes.count())
    take = F.least("__size", F.greatest(F.lit(1), F.bround(F.col("__size") * F.lit(share)).cast("long")))
    chosen = cut(placed.select(group, F.when(F.col("__n") <= take, names[0]).otherwise(names[1]).alias("split")), "splits")
    return join_checked(df, chosen, [group], "inner", chosen.count())


def batches(df: DataFrame, key: Column, size: int, seed: str = "") -> DataFrame:
    """Adds ``batch`` and ``place``: rows in an order shuffled by the seed, cut into batches of ``size``; the last may be shorter."""
    placed = ordered.ranked(df.withColumn("__h", hash_order(key, seed)).withColumn("__k", key), [], [F.col("__h"), F.col("__k")], "__n")
    return placed.select(*df.columns, F.expr(f"cast((__n - 1) div {size} as long)").alias("batch"), F.expr(f"cast((__n - 1) % {size} as int)").alias("place"))
