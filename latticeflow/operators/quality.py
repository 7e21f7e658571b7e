"""Quality control: cascades of rules in which the first failing one names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]], passed: str = "passed") -> Column:
    """The name of the first rule that holds; a null condition does not hold."""
    out = F.when(rules[0][1], rules[0][0])
    for name, condition in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(passed)


def structure_reason(most_resolution: float = 3.5, least_area: float = 200.0) -> Column:
    """The cascade over columns metadata_error, method, resolution, read_error, n_chains, n_pairs, area_failed and max_area.

    A missing resolution passes; the method must name X-ray diffraction.
    """
    method = F.upper(F.coalesce("method", F.lit("")))
    return first_reason(
        [
            ("metadata_error", F.col("metadata_error")),
            ("non_xray_method", ~method.contains("X-RAY DIFFRACTION")),
            ("low_resolution", F.col("resolution") > most_resolution),
            ("read_structure_error", F.col("read_error")),
            ("too_few_protein_chains", F.col("n_chains") < 2),
            ("no_contacting_pairs_prefilter", F.col("n_pairs") == 0),
            ("bsa_calc_failed", F.col("area_failed")),
            ("small_interface_bsa", F.coalesce("max_area", F.lit(0.0)) < least_area),
        ]
    )


def first_sufficient(pairs: DataFrame, keys: list[str], order: str, value: str, least: float) -> DataFrame:
    """Per key, the first pair by ``order`` whose value reaches ``least``: the variant of the cascade that stops early."""
    return pairs.filter(F.col(value) >= least).groupBy(*keys).agg(F.min_by(F.struct(F.col(order), F.col(value)), F.col(order)).alias("first")).select(*keys, "first.*")


def coverage_threshold(length: Column, override: float | None = None) -> Column:
    """Least contact coverage by window length; ``override`` replaces all of them."""
    return F.lit(override) if override is not None else F.when(length <= 10, 0.5).when(length <= 14, 0.4).otherwise(0.3)


def window_reason(least_average: float = 3.5, override: float | None = None) -> Column:
    """Null for a window that passes, else the first rule it breaks."""
    return F.when(F.col("avg_contact_count") < least_average, "low_avg_contact_count").when(F.col("contact_coverage") < coverage_threshold(F.col("peptide_length"), override), "low_contact_coverage")


def burial_prescreen() -> Column:
    """Whether a window is worth a surface calculation."""
    return (F.col("n_contact_residues") >= 2) & (F.col("contact_coverage") >= 0.25) & (F.col("pocket_size") >= 2)


def first_generation_reason(most_resolution: float = 3.5, least_area: float = 200.0) -> Column:
    """The earlier cascade's labels, over columns metadata_error and assembly_error and exception (names of error types or null),
    method, resolution, parse_error, n_chains, n_pairs and passing_area (null if no surface could be computed)."""
    method = F.upper(F.coalesce("method", F.lit("")))
    fixed = [
        ("non_xray_method", ~method.contains("X-RAY DIFFRACTION")),
        ("low_resolution", F.col("resolution") > most_resolution),
        ("parse_error", F.col("parse_error")),
        ("assembly_error", F.col("assembly_error").isNotNull()),
        ("empty_structure", F.coalesce("n_chains", F.lit(0)) == 0),
        ("insufficient_chain_instances", F.col("n_chains") < 2),
        ("no_contacting_chain_pairs", F.coalesce("n_pairs", F.lit(0)) == 0),
        ("delta_sasa_failed", F.col("passing_area").isNull()),
        ("low_interface_buried_area", F.col("passing_area") < least_area),
    ]
    reason = first_reason([("exception", F.col("exception").isNotNull()), ("metadata_error", F.col("metadata_error").isNotNull()), *fixed], "pass")
    typed = [(name, F.col(column)) for name, column in (("exception", "exception"), ("metadata_error", "metadata_error"), ("assembly_error", "assembly_error"))]
    return F.coalesce(*(F.when(reason == name, F.concat(F.lit(f"{name}:"), of)) for name, of in typed), reason)


def passing_pair(pairs: DataFrame, keys: list[str], order: str, value: str, least: float = 200.0) -> DataFrame:
    """Per key, the pair at which a scan in ``order`` stops: the first whose value reaches ``least``, else the largest, the first of
    equal ones. Columns: keys, ``order`` and ``value``; a key without a value has none."""
    enough = F.col(value) >= least
    rank = F.struct((~enough).alias("late"), F.when(enough, F.lit(0.0)).otherwise(-F.col(value)).alias("area"), F.col(order).alias("place"))
    best = pairs.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(order, value), rank).alias("first"))
    return best.select(*keys, "first.*")


def window_error(start: str = "start", end: str = "end", residues: str = "n_residues", sequence: str = "sequence") -> Column:
    """Why a window's row does not fit its chain any more: null if it does. For ``sinks.dead_letters``."""
    return (
        F.when(F.col(start).isNull() | F.col(end).isNull(), "missing window indices")
        .when(F.col(residues).isNull(), "missing chain")
        .when((F.col(start) < 0) | (F.col(end) < F.col(start)) | (F.col(end) >= F.col(residues)), "window out of bounds")
        .when(F.coalesce(F.char_length(sequence), F.lit(0)) == 0, "empty window")
        .when(F.char_length(sequence) != F.col(end) - F.col(start) + 1, "window bounds mismatch")
    )
