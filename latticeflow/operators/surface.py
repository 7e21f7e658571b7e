"""Solvent-accessible surface by test points on spheres, in numpy blocks: one call a complex or window."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

PROBE, POINTS = 1.4, 500


def sphere(points: int) -> np.ndarray:
    """Points spread evenly over the unit sphere along a golden spiral."""
    i = np.arange(points) + 0.5
    polar, around = np.arccos(1 - 2 * i / points), np.pi * (1 + 5**0.5) * i
    return np.stack([np.cos(around) * np.sin(polar), np.sin(around) * np.sin(polar), np.cos(polar)], 1)


def accessible_areas(xyz: np.ndarray, radii: np.ndarray, probe: float = PROBE, points: int = POINTS) -> np.ndarray:
    """Each atom's accessible area: the share of its points outside all other enlarged spheres. Neighbours come from grid cells."""
    n = len(xyz)
    out, unit, big = np.zeros(n), sphere(points), radii + probe
    if not n:
        return out
    width = 2 * big.max()
    cells: dict[tuple, list[int]] = {}
    index = np.floor(xyz / width).astype(int)
    for i, c in enumerate(map(tuple, index)):
        cells.setdefault(c, []).append(i)
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for cell, own in cells.items():
        near = np.array([j for s in steps for j in cells.get((cell[0] + s[0], cell[1] + s[1], cell[2] + s[2]), ())])
        for i in own:
            d2 = ((xyz[near] - xyz[i]) ** 2).sum(1)
            close = near[(d2 < (big[near] + big[i]) ** 2) & (near != i)]
            test = xyz[i] + unit * big[i]
            hidden = np.zeros(points, bool)
            for j in close[np.argsort(((xyz[close] - xyz[i]) ** 2).sum(1))]:
                hidden |= ((test - xyz[j]) ** 2).sum(1) < big[j] ** 2
            out[i] = 4 * np.pi * big[i] ** 2 * (1 - hidden.mean())
    return out


def _radii(elements, names) -> np.ndarray:
    return np.array([S.RADII.get((e or n[:1]).upper(), S.OTHER_RADIUS) for e, n in zip(elements, names)])


def interface_areas(atoms: DataFrame, pairs: DataFrame, probe: float = PROBE, points: int = POINTS) -> DataFrame:
    """``(source_file, a, b, delta_area)``: what two chains bury, their areas alone less that of both together.

    A pair whose surface cannot be computed has null. A group is one pair of chains.
    """
    two = pairs.select("source_file", "a", "b", F.explode(F.array("a", "b")).alias("chain_id"))
    given = two.join(atoms.select("source_file", "chain_id", "element", "atom_name", "x", "y", "z"), ["source_file", "chain_id"])

    def area(pdf):
        import pandas as pd

        xyz, radii = pdf[["x", "y", "z"]].to_numpy(), _radii(pdf["element"], pdf["atom_name"])
        first = (pdf["chain_id"] == pdf["a"]).to_numpy()
        try:
            delta = sum(accessible_areas(xyz[m], radii[m], probe, points).sum() for m in (first, ~first)) - accessible_areas(xyz, radii, probe, points).sum()
        except (ValueError, MemoryError):
            delta = None
        return pd.DataFrame({"source_file": [pdf["source_file"].iloc[0]], "a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "delta_area": [delta]})

    return given.groupBy("source_file", "a", "b").applyInPandas(area, "source_file string, a string, b string, delta_area double")


def window_burial(atoms: DataFrame, tasks: DataFrame, wins: DataFrame, probe: float = PROBE, points: int = POINTS, key: str = "candidate_id") -> DataFrame:
    """Per window: free, bound and buried area and the buried share, for the window's atoms alone and beside the receptor.

    Only receptor atoms in the window's box, widened by what two atoms and the probe can span, are sent along. A group is one window.
    """
    t = wins.select(key, "task_id", "left", "right").join(tasks.select("task_id", "source_file", "receptor", "peptide"), "task_id")
    columns = ["element", "atom_name", "x", "y", "z"]
    own = atoms.select("source_file", F.col("chain_id").alias("peptide"), "res_index", *columns).join(t, ["source_file", "peptide"]).filter("res_index between left and right").select(key, F.lit(True).alias("own"), *columns)
    widest = 2 * (max(*S.RADII.values(), S.OTHER_RADIUS) + probe)
    boxes = own.groupBy(key).agg(*(f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("low", F.min), ("high", F.max))))
    inside = reduce(and_, (F.col(c).between(F.col(f"low_{c}") - widest, F.col(f"high_{c}") + widest) for c in "xyz"))
    other = atoms.select("source_file", F.col("chain_id").alias("receptor"), *columns).join(t.join(boxes, key), ["source_file", "receptor"]).filter(inside).select(key, F.lit(False).alias("own"), *columns)
    kind = wins.schema[key].dataType.simpleString()

    def burial(pdf):
        import pandas as pd

        own = pdf["own"].to_numpy()
        xyz, radii = pdf[["x", "y", "z"]].to_numpy(), _radii(pdf["element"], pdf["atom_name"])
        reach = 2 * (radii.max() + probe)
        low, high = xyz[own].min(0) - reach, xyz[own].max(0) + reach
        near = own | ((xyz >= low) & (xyz <= high)).all(1)
        free = accessible_areas(xyz[own], radii[own], probe, points).sum()
        bound = accessible_areas(xyz[near], radii[near], probe, points)[own[near]].sum()
        share = max(0.0, free - bound) / free if free > 0 else 0.0
        return pd.DataFrame({key: [pdf[key].iloc[0]], "area_free": [free], "area_bound": [bound], "area_buried": [max(0.0, free - bound)], "burial": [share]})

    return own.unionByName(other).groupBy(key).applyInPandas(burial, f"{key} {kind}, area_free double, area_bound double, area_buried double, burial double")
