"""The contact-count pipeline over structure files: QC, tasks, windows, filter, sample, joint deduplication, metadata, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import greedy, joins, ordered, quality, sampling, structure, summary, surface
from ..sources import sinks, structures


def quality_control(texts: DataFrame, atoms: DataFrame, most_resolution: float = 3.5, least_area: float = 200.0, cutoff: float = 6.0, points: int = surface.POINTS) -> DataFrame:
    """One row a file with its first failing reason; surfaces are computed only for files that pass all cheaper rules."""
    meta = structures.metadata(texts)
    n = atoms.groupBy("source_file").agg(F.count_distinct("chain_id").alias("n_chains"))
    pairs = structure.chain_pairs(atoms, cutoff)
    near = pairs.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_pairs"))
    base = meta.join(n, "source_file", "left").join(near, "source_file", "left").na.fill(0, ["n_chains", "n_pairs"])
    base = base.withColumn("read_error", (F.col("n_chains") == 0) & ~F.col("metadata_error") & (F.col("n_atoms") == 0))
    early = quality.structure_reason(most_resolution, least_area)
    cheap = base.withColumns({"area_failed": F.lit(False), "max_area": F.lit(1e300)}).filter(early == "passed").select("source_file")
    areas = surface.interface_areas(atoms, pairs.join(cheap, "source_file", "left_semi"), points=points)
    place = atoms.select("source_file", "chain_id", "chain_order").distinct()
    areas = areas.join(place.toDF("source_file", "a", "oa"), ["source_file", "a"]).join(place.toDF("source_file", "b", "ob"), ["source_file", "b"])
    best = areas.groupBy("source_file").agg(F.max("delta_area").alias("max_area"), F.min_by(S.pair_id(F.col("a"), F.col("b")), F.when(F.col("delta_area").isNotNull(), F.struct(-F.col("delta_area"), "oa", "ob"))).alias("passing_pair"), F.min(F.col("delta_area").isNull()).alias("area_failed"))
    out = base.join(best, "source_file", "left").withColumn("area_failed", F.coalesce("area_failed", F.lit(False)))
    out = out.withColumn("reason", early).withColumn("passed", F.col("reason") == "passed").withColumn("resolution_missing", F.col("resolution").isNull())
    return out.select("source_file", "pdb_id", "passed", "reason", "method", "resolution", "resolution_missing", "n_chains", "n_pairs", "max_area", "passing_pair")


def candidates(atoms: DataFrame, tasks: DataFrame, cutoff: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """The windows of all tasks after length-band quotas (6, 6 and 4, sixteen in all), and the contact frame they come from."""
    res = structure.residues(atoms)
    frame = structure.contact_frame(atoms, res, tasks, cutoff)
    seeds = tasks.select("task_id", F.explode("source_contact_residue_ids").alias("residue_id"))
    picked = structure.anchors(frame, seeds)
    wins = structure.windows(frame, picked)
    order = [F.desc("avg_contact_count"), F.col("rank"), F.col("peptide_length"), F.col("left")]
    kept = ordered.band_quota_backfill(wins, ["task_id"], "length_band", {"8_10": 6, "11_14": 6, "15_20": 4}, order, 16, "window_rank")
    return kept.withColumn("candidate_id", S.uuid5(F.concat_ws("::", "task_id", "left", "right"))), frame


def filtered(wins: DataFrame, override: float | None = None, keep_failed: bool = False) -> DataFrame:
    out = wins.withColumn("drop_reason", quality.window_reason(override=override)).withColumn("passes", F.col("drop_reason").isNull())
    return out if keep_failed else out.filter("passes")


def sampled(wins: DataFrame, k: int = 4, most_short: int = 2, alpha: float = 0.0, seed: int = 20260416) -> DataFrame:
    """``keep_prob_proxy`` by mean contacts, then seeded draws. ``alpha`` favours longer windows; 0 leaves the weight as it is."""
    weighted = wins.withColumn("sampling_weight", F.col("avg_contact_count") * F.pow(F.col("peptide_length") / F.lit(8.0), F.lit(alpha)))
    shared = ordered.with_share(weighted, ["task_id"], F.greatest(F.col("sampling_weight"), F.lit(1e-6)), "keep_prob_proxy")
    return sampling.seeded_sample(shared, "task_id", "sampling_weight", "peptide_length", ["window_rank"], k, 8, most_short, seed)


def deduplicated(rows: DataFrame, least: float = 0.85, least_ratio: float = 0.70) -> DataFrame:
    """Adds ``kept``, ``drop_reason`` and ``duplicate_of``: of windows alike in peptide and receptor the longest, then best one stays.

    ``rows`` has candidate_id, peptide_sequence, receptor_sequence and the window statistics.
    """
    rank = F.struct((-F.col("peptide_length")).alias("l"), (-F.col("avg_contact_count")).alias("a"), (-F.col("contact_coverage")).alias("c"))
    pairs = joins.kmer_conflicts(rows, "candidate_id", "peptide_sequence", "receptor_sequence", least, least_ratio)
    chosen = greedy.independent_set(rows.select(F.col("candidate_id").alias("id"), rank.alias("priority")), pairs.select("a", "b"))
    out = rows.join(chosen.select(F.col("id").alias("candidate_id"), "kept", F.col("by").alias("duplicate_of")), "candidate_id")
    return out.withColumn("drop_reason", F.when(~F.col("kept"), "joint_receptor_peptide_homology"))


def finalised(rows: DataFrame, atoms: DataFrame, tasks: DataFrame, frame: DataFrame) -> DataFrame:
    """Kept windows with their receptor patch, caps and termini."""
    patch = structure.patches(frame, structure.residues(atoms), tasks, rows)
    return structure.caps(frame, rows).join(patch, "candidate_id", "left").withColumn("patch_cutoff", F.lit(6.0))


def final_summary(rows: DataFrame) -> DataFrame:
    return summary.numeric_summary(rows, ["peptide_length", "avg_contact_count", "contact_coverage", "patch_num_residues"])


def run(spark: SparkSession, folder: str, pattern: str = "*.cif", monitor: float = 0.10, seed: int = 20260416, points: int = surface.POINTS) -> dict[str, DataFrame]:
    """All stages over a folder; a dict of the stages' frames. Cheap filters come before surfaces and joins."""
    from ..storage import cut

    texts = structures.files(spark, folder, pattern)
    read = cut(structures.parsed(texts), "parsed")
    every = structures.good(read)
    qc = cut(quality_control(texts, every, points=points), "qc")
    atoms = every.join(qc.filter("passed").select("source_file"), "source_file", "left_semi")
    tasks = cut(structure.directed_tasks(atoms), "tasks")
    wins, frame = candidates(atoms, tasks)
    frame, wins = cut(frame, "frame"), cut(wins, "windows")
    chosen = sampled(filtered(wins), seed=seed)
    seqs = structure.chains(structure.residues(atoms)).select("source_file", F.col("chain_id").alias("receptor"), F.col("sequence").alias("receptor_sequence"))
    named = cut(chosen.join(tasks.select("task_id", "source_file", "pdb_id", "receptor", "peptide", "chain_pair_id", "direction"), "task_id").join(seqs, ["source_file", "receptor"]), "sampled")
    dedup = cut(deduplicated(named), "dedup")
    split = sampling.row_split(dedup.filter("kept"), F.col("candidate_id"), monitor, str(seed))
    sizes = structure.chains(structure.residues(atoms)).select("source_file", F.col("chain_id").alias("peptide"), "n_residues")
    lengths = split.join(sizes, ["source_file", "peptide"], "left").withColumns({"__end": F.col("right"), "__start": F.col("left")})
    fit, unfit = sinks.dead_letters(lengths, quality.window_error("__start", "__end", "n_residues", "peptide_sequence"))
    final = cut(finalised(fit.drop("__start", "__end", "n_residues"), atoms, tasks, frame), "final")
    unfit = unfit.select(F.col("candidate_id").alias("id"), F.lit("window").alias("type"), F.col("error").alias("message"))
    errors = cut(structures.failed(read).select(F.col("source_file").alias("id"), "type", "message").unionByName(unfit), "errors")
    return {"errors": errors, "qc": qc, "tasks": tasks, "windows": wins, "dropped": dedup.filter("not kept"), "final": final, "summary": final_summary(final)}
