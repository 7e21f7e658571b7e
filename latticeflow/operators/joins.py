"""Joins: merges of stages, lookups with defaults, radius and interval joins, k-mer blocking, nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import cut, join_counted, join_shuffled, with_batches


def last_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge_stages(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which the right side's columns replace the left side's of the same name."""
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    return left.drop(*clash).join(right, keys)


def merge_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys on both sides, and on one side only, from one full join of the distinct keys."""
    sides = left.select(*keys).distinct().withColumn("l", F.lit(True)).join(right.select(*keys).distinct().withColumn("r", F.lit(True)), keys, "full")
    return sides.agg(F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def with_lookup(df: DataFrame, small: DataFrame, keys: list[str], values: dict[str, object], most: int = 100_000) -> DataFrame:
    """Left join with a small table, with defaults where it has no row. It is broadcast if it is seen to be small."""
    size = small.limit(most + 1).count()
    out = df.join(F.broadcast(small) if size <= most else small, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in values.items()})


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair as two rows with ``peptide`` and ``receptor``."""
    two = F.array(F.struct(F.col(b).alias("peptide"), F.col(a).alias("receptor")), F.struct(F.col(a).alias("peptide"), F.col(b).alias("receptor")))
    return pairs.withColumn("__d", F.explode(two)).select(*pairs.columns, "__d.*")


def unordered_pairs(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Pairs ``a < b`` of a group's items; a group is the chains of one structure or the like."""
    a, b = df.select(*keys, F.col(item).alias("a")), df.select(*keys, F.col(item).alias("b"))
    return a.join(b, keys).filter("a < b")


def _cells(df: DataFrame, axes: list[str], radius: float, around: bool) -> DataFrame:
    """``df`` with the grid cell ``__c0``, ``__c1``, ... of each row, or a row for each of the cells around it."""
    for i, c in enumerate(axes):
        cell = F.floor(F.col(c) / F.lit(radius)).cast("long")
        df = df.withColumn(f"__c{i}", F.explode(F.array(*(F.try_add(cell, F.lit(d).cast("long")) for d in (-1, 0, 1)))) if around else cell)
    return df


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], axes: list[str], radius: float, prefix: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Pairs within ``radius`` of each other (inclusive), as an equi-join on grid cells of that width.

    The right side is put into all cells next to its own, so each pair meets in exactly one cell, the left point's own. Columns get
    prefixes, keys do not; ``distance`` is added. Rows without coordinates meet nothing.
    """
    cells = [f"__c{i}" for i in range(len(axes))]
    own = _cells(left, axes, radius, False).select(*keys, *(F.col(c).alias(prefix[0] + c) for c in left.columns if c not in keys), *cells)
    near = _cells(right, axes, radius, True).select(*keys, *(F.col(c).alias(prefix[1] + c) for c in right.columns if c not in keys), *cells)
    square = sum((F.col(prefix[0] + c) - F.col(prefix[1] + c)) * (F.col(prefix[0] + c) - F.col(prefix[1] + c)) for c in axes)
    met = join_shuffled(own, near, [*keys, *cells]).withColumn("distance", F.sqrt(square))
    return met.filter(F.col("distance") <= F.lit(radius)).drop(*cells)


#: Points of a cell that are listed in one row, at most as a rule, on the left and on the right, and distances computed at once.
LEFT_POINTS, RIGHT_POINTS, DISTANCES = 2048, 8192, 1 << 19


def _point_lists(df: DataFrame, by: list[str], axes: list[str], most: int, names: tuple[str, str]) -> DataFrame:
    """Rows ``by``, ids, points: the points of a cell in parts of ``most`` or so, dealt by a hash of all they have."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    dealt = join_shuffled(df, sizes, by).withColumn("__part", F.pmod(F.xxhash64("id", *axes), F.ceil(F.col("__n") / most)))
    point = F.struct(F.col("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(axes)))
    lists = dealt.groupBy(*by, "__part").agg(F.collect_list(point).alias("p"))
    return lists.select(*by, F.col("p.id").alias(names[0]), F.array(*(F.col(f"p.x{i}") for i in range(len(axes)))).alias(names[1]))


def _count_nearest(points: np.ndarray, others: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``points`` how many ``others`` are within ``radius``, the least distance, and the first place that has it.
    Distances are added up axis by axis, as SQL does it.
    """
    near, least, which = np.zeros(points.shape[1], np.int64), np.full(points.shape[1], np.inf), np.zeros(points.shape[1], np.int64)
    step = max(1, DISTANCES // max(1, others.shape[1]))
    for a in range(0, points.shape[1], step):
        square = 0.0
        for x, y in zip(points[:, a : a + step], others):
            gap = x[:, None] - y[None, :]
            square = square + gap * gap
        d = np.sqrt(square)
        met = d <= radius
        d = np.where(met, d, np.inf)
        near[a : a + step], at = met.sum(1), d.argmin(1)
        least[a : a + step], which[a : a + step] = d[np.arange(len(at)), at], at
    return near, least, which


def radius_nearest(left: DataFrame, right: DataFrame, keys: list[str], axes: list[str], radius: float, item: str = "id") -> DataFrame:
    """(id, near, nearest, min_distance): for each ``item`` of the left, a long, the number of its pairs in ``radius_join``, and its nearest
    item of the right (ties: the least, null last), without a row a pair. Items without a pair are left out.

    Each cell's points and all points around it are packed into lists; every list of the one meets every list of the other in one row,
    which becomes a row a left point. Nothing is broadcast, and no task holds more than two lists at once.
    """
    cells = [*keys, *(f"__c{i}" for i in range(len(axes)))]
    side = lambda df: df.select(*keys, F.col(item).cast("long").alias("id"), *axes).filter(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in axes))
    own = _point_lists(_cells(side(left), axes, radius, False), cells, axes, LEFT_POINTS, ("l_ids", "l_points"))
    near = _point_lists(_cells(side(right), axes, radius, True), cells, axes, RIGHT_POINTS, ("r_ids", "r_points"))
    met = join_shuffled(own, near, cells).select("l_ids", "l_points", "r_ids", "r_points")

    def coordinates(lists):
        return np.stack([np.asarray(lists[i].values, np.float64) for i in range(len(lists))])

    def counted(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                l_ids, l_points, r_ids, r_points = (batch.column(c)[at].values for c in range(4))
                # Ascending ids, nulls last: of equal distances the first is the least id.
                order = np.lexsort((np.asarray(r_ids.fill_null(0), np.int64), np.asarray(r_ids.is_null())))
                r_ids = r_ids.take(pa.array(order))
                n, d, which = _count_nearest(coordinates(l_points), coordinates(r_points)[:, order], radius)
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([l_ids.take(some), *(pa.array(x[n > 0]) for x in (n, d)), r_ids.take(pa.array(which[n > 0]))], ["id", "near", "d", "other"])

    dealt = with_batches(met).mapInArrow(counted, "id long, near long, d double, other long")
    best = F.min(F.struct("d", F.col("other").isNull().alias("none"), "other")).alias("m")
    return dealt.groupBy("id").agg(F.sum("near").alias("near"), best).select("id", "near", F.col("m.other").alias("nearest"), F.col("m.d").alias("min_distance"))


def nearest(pairs: DataFrame, keys: list[str], other: str, distance: str = "distance", tie: str | None = None) -> DataFrame:
    """Per key, the nearest ``other`` (ties: by ``tie``, then the least one) and its distance."""
    m = F.min(F.struct(F.col(distance).alias("d"), (F.col(tie) if tie else F.lit(0)).alias("t"), F.col(other).alias("o")))
    return pairs.groupBy(*keys).agg(m.alias("m")).select(*keys, F.col("m.o").alias("nearest"), F.col("m.d").alias("min_distance"))


def interval_conflicts(df: DataFrame, keys: list[str], key: str, left: str, right: str, anchors: tuple[str, str] | None = None, least_iou: float = 0.8, anchor_gap: int = 2, length_gap: int = 2) -> DataFrame:
    """Pairs ``a < b`` of a group's intervals that repeat each other: one contains the other or their overlap over union is at
    least ``least_iou``, their lengths differ by ``length_gap`` at most, and both anchors by ``anchor_gap`` at most.
    """
    cols = [key, left, right, *(anchors or ())]
    a = df.select(*keys, *(F.col(c).alias(f"a_{c}") for c in cols))
    b = df.select(*keys, *(F.col(c).alias(f"b_{c}") for c in cols))
    sides = [F.col(f"{s}_{c}") for s in "ab" for c in (left, right)]
    same = S.contains_either(*sides) | (S.interval_iou(*sides) >= least_iou)
    length = lambda s: F.col(f"{s}_{right}") - F.col(f"{s}_{left}")
    close = F.abs(length("a") - length("b")) <= length_gap
    for c in anchors or ():
        close = close & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= anchor_gap)
    met = a.join(b, keys).filter(F.col(f"a_{key}") < F.col(f"b_{key}")).filter(close & same)
    return met.select(*keys, F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), S.interval_iou(*sides).alias("iou"))


def distinct_modes(length_difference: Column, first_gap: Column, second_gap: Column, iou: Column) -> Column:
    """Whether two windows count as different ways of binding, however much they overlap."""
    return (length_difference >= 5) | ((first_gap >= 4) & (second_gap >= 4)) | (iou <= 0.6)


def _pieces(df: DataFrame, text: str, keep: list[str], least: float, shorter: bool) -> DataFrame:
    """Rows ``keep``, __la, __lb, __p, __piece: what a text has in common with any other that it can be alike, as the shorter or the
    longer one of the two (both, at equal lengths).

    Texts of ``la`` and ``lb >= la`` letters that agree in ``least`` of ``lb`` places differ in at most
    ``floor((1 - least) * lb) - (lb - la)`` of the first ``la``; cut into one piece more, they share a piece at its place.
    """
    n = F.char_length(text)
    other = F.sequence(n, F.floor(n / F.lit(least) + F.lit(1e-9)).cast("int")) if shorter else F.sequence(F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int"), n)
    sized = df.filter(n > 0).select(*keep, F.col(text).alias("__t"), n.alias("__n"), F.explode(other).alias("__o"))
    la, lb = (F.col("__n"), F.col("__o")) if shorter else (F.col("__o"), F.col("__n"))
    sized = sized.select(*keep, "__t", la.alias("__la"), lb.alias("__lb")).filter(_differing(least) >= 0)
    cut_ = sized.select("*", F.explode(F.sequence(F.lit(0), _differing(least))).alias("__p"))
    return cut_.select(*keep, "__la", "__lb", "__p", _piece(F.col("__t"), F.col("__p"), least).alias("__piece"))


_PIECE = ["__la", "__lb", "__p", "__piece"]


def _differing(least: float) -> Column:
    """In how many of the first ``__la`` places two alike texts of ``__la`` and ``__lb`` letters can differ; negative: there are none."""
    return F.floor(F.lit(1 - least) * F.col("__lb") + F.lit(1e-9)).cast("int") - (F.col("__lb") - F.col("__la"))


def _piece(text: Column, p: Column, least: float) -> Column:
    place = lambda i: F.floor(i * F.col("__la") / (_differing(least) + 1)).cast("int")
    return F.substring(text, place(p) + 1, place(p + 1) - place(p))


def _first_shared(a: str, b: str, least: float) -> Column:
    """Whether the piece by which two texts have met is the first that they share, so that of all their meetings one counts."""
    return ~F.exists(F.slice(F.sequence(F.lit(0), F.col("__p")), F.lit(1), F.col("__p")), lambda q: _piece(F.col(a), q, least) == _piece(F.col(b), q, least))


#: Keys of a class of equal sequences that are listed in one row, and pairs that a task writes, as a rule.
MEMBERS, PAIRS = 1000, 4_000_000


def sequence_classes(df: DataFrame, short: str, long: str) -> DataFrame:
    """Rows class, s, l, n: the different pairs of sequences of ``df``, numbered, and how many rows have each. Pairs with a null or an
    empty sequence are like nothing, themselves included, and are left out.
    """
    s, l = F.col(short).alias("s"), F.col(long).alias("l")  # noqa: E741
    sized = df.select(s, l).filter("char_length(s) > 0 and char_length(l) > 0").groupBy("s", "l").agg(F.count(F.lit(1)).alias("n"))
    return cut(sized.select(F.monotonically_increasing_id().alias("class"), "*"), "classes")


def class_conflicts(classes: DataFrame, least: float = 0.85, least_ratio: float = 0.70) -> DataFrame:
    """Pairs ``x < y`` of different ``classes`` whose short sequences share a k-mer (k is 3 up to ten letters, else 4) and whose both
    sequences are identical, position by position, to ``least`` or more.

    Short and long rows with different k never meet. Alike sequences share a piece at its place, of which there are fewer than of
    k-mers and which are longer: different short sequences meet by theirs, classes of alike short ones by those of their long ones.
    """
    least = max(least, least_ratio)
    texts = classes.select("s").distinct()
    sides = _pieces(texts.select("s", F.col("s").alias("as")), "s", ["as"], least, True), _pieces(texts.select("s", F.col("s").alias("bs")), "s", ["bs"], least, False)
    met = join_shuffled(*sides, _PIECE).filter(_first_shared("as", "bs", least)).select("as", "bs")
    k = lambda c: F.when(F.char_length(c) <= 10, 3).otherwise(4)
    alike = met.filter(k("as") == k("bs")).withColumn("short_identity", S.positional_identity(F.col("as"), F.col("bs"))).filter(F.col("short_identity") >= least)
    alike = alike.filter(F.arrays_overlap(S.kmers(F.col("as"), k("as")), S.kmers(F.col("bs"), k("bs"))))
    # Each alike pair in both orders, so that either of two classes may have the shorter long sequence.
    alike = alike.unionByName(alike.select(F.col("bs").alias("as"), F.col("as").alias("bs"), "short_identity")).distinct()
    full = classes.select(F.col("class").alias("id"), "s", "l")
    left = _pieces(full, "l", ["id", "s", "l"], least, True).withColumnsRenamed({"id": "x", "s": "as", "l": "xl"})
    right = _pieces(full, "l", ["id", "s", "l"], least, False).withColumnsRenamed({"id": "y", "s": "bs", "l": "yl"})
    both = join_shuffled(join_shuffled(left, alike, "as"), right, ["bs", *_PIECE])
    # Classes with long sequences of one length meet in both orders, others in one.
    both = both.filter("x < y or x > y and __la < __lb").filter(_first_shared("xl", "yl", least))
    scored = both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "short_identity", S.positional_identity(F.col("xl"), F.col("yl")).alias("long_identity"))
    return scored.filter(F.col("long_identity") >= least)


def with_class(df: DataFrame, classes: DataFrame, short: str, long: str) -> DataFrame:
    """``df`` with the ``class`` of its sequences, and its rows ``n``; null where they have none. Large classes are not shuffled."""
    total = int(classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    own = (F.char_length(short) > 0) & (F.char_length(long) > 0)
    named = df.filter(own).withColumns({"__s": F.col(short), "__l": F.col(long)})
    met = join_counted(named, classes.select(F.col("s").alias("__s"), F.col("l").alias("__l"), "class", "n", F.col("n").alias("__n")), ["__s", "__l"], "inner", "__n", total)
    none = F.lit(None).cast("long")
    return met.select(*df.columns, "class", "n").unionByName(df.filter(~F.coalesce(own, F.lit(False))).withColumns({"class": none, "n": none}))


def kmer_conflicts(df: DataFrame, key: str, short: str, long: str, least: float = 0.85, least_ratio: float = 0.70) -> DataFrame:
    """Pairs ``a < b`` of rows of the same or of conflicting classes (``class_conflicts``), each once, with both identities.

    Only classes are compared; their pairs are spelt out last, from lists of MEMBERS keys at most, and not shuffled any more.
    """
    classes = sequence_classes(df, short, long)
    pairs = class_conflicts(classes, least, least_ratio)
    equal = classes.select(F.col("class").alias("x"), F.col("class").alias("y"), F.lit(1.0).alias("short_identity"), F.lit(1.0).alias("long_identity"))
    pairs = cut(pairs.unionByName(equal), "class-pairs") if least <= 1 else pairs.limit(0)
    rows = df.select(F.col(key).alias("id"), F.col(short).alias("s"), F.col(long).alias("l")).filter("id is not null").distinct()
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS)).alias("part")
    lists = cut(with_class(rows, classes, "s", "l").filter("class is not null").groupBy("class", part).agg(F.collect_list("id").alias("ids")), "members")
    side = lambda c: lists.select(F.col("class").alias(c), F.col("part").alias(f"{c}_part"), F.col("ids").alias(f"{c}_ids"))
    met = join_shuffled(join_shuffled(pairs, side("x"), "x"), side("y"), "y").filter("x <> y or x_part <= y_part")
    met = cut(met.withColumn("pairs", F.size("x_ids").cast("long") * F.size("y_ids")), "lists")
    many = int(met.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
    dealt = met.repartition(max(8, min(many // PAIRS + 1, 100_000)))
    each = dealt.withColumn("a", F.explode("x_ids")).select("a", "x", "y", "x_part", "y_part", F.explode("y_ids").alias("b"), "short_identity", "long_identity")
    # Within one list each pair is met in both orders, between two lists in one.
    each = each.filter(F.when((F.col("x") == F.col("y")) & (F.col("x_part") == F.col("y_part")), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "short_identity", "long_identity")


def equal_key_pairs(df: DataFrame, group: list[str], key: str, item: str) -> DataFrame:
    """Pairs of different items of a group that share a key (the false negatives of a batch)."""
    a, b = df.select(*group, key, F.col(item).alias("a")), df.select(*group, key, F.col(item).alias("b"))
    return a.join(b, [*group, key]).filter("a <> b")


def page_references(rows: DataFrame, reference: str, pages: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``rows`` with ``found``: the ``value`` of the page that a reference means, or null.

    A reference with bars is tried part by part from the last, then whole: an equal key first, else the first key in ``order`` that it
    ends with. Ends are met by equality: a reference is joined with all that it can end with.
    """
    numbered = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "references")
    whole = F.trim(F.coalesce(reference, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    tried = F.when(F.contains(whole, F.lit("|")), F.concat(F.reverse(parts), F.array(whole))).otherwise(F.array(whole))
    each = numbered.select("__row", F.posexplode(tried).alias("__try", "__text")).filter("__text <> ''")
    ends = each.select("__row", "__try", "__text", F.explode(F.sequence(F.lit(1), F.char_length("__text"))).alias("__from")).select("__row", "__try", "__from", F.expr("substring(__text, __from)").alias("__end"))
    known = pages.select(F.col(key).alias("__end"), F.col(value).alias("found"), F.col(order).alias("__order"))
    met = ends.join(known, "__end")
    rank = F.struct("__try", (F.col("__from") > 1).alias("part"), F.when(F.col("__from") > 1, F.col("__order")).alias("order"))
    best = met.groupBy("__row").agg(F.min_by("found", rank).alias("found"))
    return numbered.join(best, "__row", "left").drop("__row")
