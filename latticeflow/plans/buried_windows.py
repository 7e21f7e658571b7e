"""The buried-area pipeline: windows around near anchors, surface scores, clone removal and sampling, matching to a reference
distribution, clusters, caps, group-safe split, realignment after the cap, and key-value tracks.

Each stage's result is written to the shared folder, so the next one plans from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters, density, greedy, joins, ordered, quality, sampling, structure, surface
from ..storage import cut

INF = float("inf")
#: Edges of the three axes of the reference grid.
EDGES = {"patch_bin": [-0.1, 25.0, 50.0, 100.0, INF], "peptide_bin": [-0.1, 8.0, 14.0, INF], "burial_bin": [-0.01, 0.35, 0.7, INF]}
AXES = {k: [f"[{a}, {b})" for a, b in zip(v, v[1:])] for k, v in EDGES.items()}
MEASURES = {"patch_bin": "pocket_size", "peptide_bin": "peptide_length", "burial_bin": "burial"}


def windows(frame: DataFrame, contact_pairs: DataFrame, anchor_cutoff: float = 5.0, cutoff: float = 6.0, most_anchors: int = 5, gap: int = 3, least_contacts: int = 4, least_ratio: float = 0.5, most_windows: int = 24) -> DataFrame:
    """Windows of each anchor (nearest residues first, at least ``gap`` apart), by share of residues nearer than ``cutoff``.

    Both cutoffs are strict. ``contact_pairs`` (task_id, pep, rec, distance) names each anchor's nearest receptor residue.
    """
    n = frame.groupBy("task_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    near = frame.filter(F.col("min_distance") < anchor_cutoff).join(n, "task_id").select("task_id", "size", "pep", "contacts", "min_distance")
    picked = greedy.spaced_positions(near, ["task_id"], "pep", ["min_distance", "-contacts", "pep"], gap - 1, most_anchors)
    nearest = joins.nearest(contact_pairs, ["task_id", "pep"], "rec").select("task_id", "pep", F.col("nearest").alias("receptor_anchor"))
    flag = (F.coalesce("min_distance", F.lit(INF)) < cutoff).cast("long")
    sums = ordered.with_prefix(frame.withColumn("flag", flag), ["task_id"], [F.col("pep")], F.col("flag"), "s")
    a = sums.select("task_id", F.col("pep").alias("left"), F.col("breaks").alias("b0"), (F.col("s") - F.col("flag")).alias("s0"))
    b = sums.select("task_id", F.col("pep").alias("right"), F.col("breaks").alias("b1"), F.col("s").alias("s1"))
    every = ordered.enumerate_windows(picked, "size", "pep", 8, 20).join(a, ["task_id", "left"]).join(b, ["task_id", "right"]).filter("b0 = b1")
    every = every.withColumn("near_residues", F.col("s1") - F.col("s0")).withColumn("near_ratio", F.col("near_residues") / F.col("length")).drop("b0", "b1", "s0", "s1")
    good = every.filter((F.col("near_residues") >= least_contacts) & (F.col("near_ratio") >= least_ratio)).withColumn("offset", S.anchor_offset(F.col("pep"), F.col("left"), F.col("right")))
    order = [F.desc("near_ratio"), F.desc("near_residues"), F.abs("offset"), -F.least("length", F.lit(14)), F.col("left"), F.col("right")]
    kept = ordered.top_k(good, ["task_id", "pep"], order, most_windows, "window_index")
    kept = kept.join(nearest, ["task_id", "pep"], "left").withColumnRenamed("length", "peptide_length")
    return cut(kept.withColumn("candidate_id", S.uuid5(F.concat_ws("::", "task_id", "pep", "left", "right"))), "windows")


def scored(wins: DataFrame, frame: DataFrame, atoms: DataFrame, tasks: DataFrame, least_burial: float = 0.05, points: int = surface.POINTS) -> DataFrame:
    """Contacts, pocket size, buried share, risk and score of each window; surfaces only where the prescreen passes, else 0."""
    inside = wins.select("candidate_id", "task_id", "left", "right", "peptide_length").join(frame.select("task_id", "pep", "contacts", "atom_pairs", "touched"), "task_id").filter("pep between left and right")
    stats = inside.groupBy("candidate_id").agg(
        F.count_if(F.col("contacts") > 0).alias("n_contact_residues"), F.sum("atom_pairs").alias("n_contact_atoms"),
        F.size(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("pocket_size"),
    )
    out = structure.backbone_risk(frame, wins).join(stats, "candidate_id").withColumn("contact_coverage", F.col("n_contact_residues") / F.col("peptide_length"))
    out = cut(out.withColumn("prescreen_skipped", ~quality.burial_prescreen()), "prescreened")
    areas = surface.window_burial(atoms, tasks, out.filter("not prescreen_skipped"), points=points)
    out = out.join(areas, "candidate_id", "left").na.fill(0.0, ["area_free", "area_bound", "area_buried", "burial"])
    out = out.withColumn("score", S.window_score(F.col("burial"), F.col("contact_coverage"), F.col("covalent_bias_risk")))
    reason = quality.first_reason([("few_contact_residues", F.col("n_contact_residues") < 2), ("low_coverage", F.col("contact_coverage") < 0.25), ("small_pocket", F.col("pocket_size") < 2), ("low_burial", F.col("burial") < least_burial)], "")
    return cut(out.withColumn("drop_reason", F.nullif(reason, F.lit(""))), "scored")


def without_clones(rows: DataFrame) -> DataFrame:
    """Rows without those that repeat a better one of their task: burial, coverage, contacts, then less risk, then the id."""
    rank = F.struct((-F.col("burial")).alias("a"), (-F.col("contact_coverage")).alias("b"), (-F.col("n_contact_residues")).alias("c"), F.col("covalent_bias_risk").alias("d"))
    pairs = joins.interval_conflicts(rows, ["task_id"], "candidate_id", "left", "right", ("pep", "receptor_anchor"))
    chosen = greedy.independent_set(rows.select(F.col("candidate_id").alias("id"), rank.alias("priority")), pairs.select("a", "b"))
    return cut(rows.join(chosen.filter("kept").select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi"), "distinct")


def selected(rows: DataFrame, k: int = 5, threshold: float = 0.5, seed: str = "20260406", draw: bool = True) -> DataFrame:
    """Up to k windows a task: weighted draws (or the best by score) among eligible ones, filled up from the rest by priority.

    Adds ``sampling_weight``, ``keep_prob``, ``selection_mode`` and the rank within the task.
    """
    fit = (F.col("peptide_length").between(8, 20)) & (F.col("contact_coverage") >= threshold) & (F.col("n_contact_residues") >= 4) & (F.col("burial") >= 0.05)
    rows = rows.withColumn("eligible", fit).withColumn("sampling_weight", sampling.coverage_weight(F.col("contact_coverage"), threshold))
    rows = ordered.with_share(rows, ["task_id", "eligible"], F.col("sampling_weight"), "keep_prob")
    by = F.log(sampling.uniform(F.col("candidate_id"), seed)) / F.greatest("sampling_weight", F.lit(1e-6)) if draw else F.col("score")
    best = [F.desc("contact_coverage"), F.desc("n_contact_residues"), F.desc("burial"), F.col("covalent_bias_risk"), F.col("candidate_id")]
    first = rows.withColumn("__by", by).withColumn("__n", F.row_number().over(ordered.over(["task_id", "eligible"], [F.desc("__by"), F.col("candidate_id")])))
    first = first.withColumn("selection_mode", F.when(F.col("eligible") & (F.col("__n") <= k), "sampling" if draw else "topk").otherwise("fallback")).drop("__by", "__n", "eligible")
    return cut(ordered.top_k(first, ["task_id"], [(F.col("selection_mode") == "fallback").cast("int"), *best], k, "rank_in_task"), "selected")


def binned(rows: DataFrame) -> DataFrame:
    """The three bins of each row, ``bin_key``, and whether any measure is outside its axis."""
    out = rows.withColumns({k: S.bin_label(F.col(MEASURES[k]), e) for k, e in EDGES.items()})
    return out.withColumn("bin_key", F.concat_ws("|", *EDGES)).withColumn("out_of_bins", ordered.any_of(*(F.col(k) == "nan" for k in EDGES)))


def matched(generated: DataFrame, reference: DataFrame, ratio: float = 0.40, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rows kept to follow the reference's distribution over the grid, and the grid: a floor a task, quotas a cell, then a fill."""
    gen, ref = cut(binned(generated), "generated"), binned(reference)
    cells = cut(density.grid_density(gen, ref, AXES), "cells")
    target = max(1, round(gen.count() * ratio * alpha))
    quotas = cut(density.apportioned(cells, "p_ref", F.lit(target), list(AXES)), "quotas")
    weighted = gen.join(F.broadcast(cells.select(*AXES, "weight")), list(AXES), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighted = cut(weighted, "weighted")
    return cut(density.quota_keep(weighted, quotas, list(AXES), ["task_id"], [F.desc("weight"), F.desc("score"), F.col("candidate_id")], target), "matched"), quotas


def capped_and_split(rows: DataFrame, families: list[str], cap: int = 200, monitor: float = 0.01, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """Rows under the group cap with a group-safe ``split``, and the rows over it."""
    there = [F.col(c) for c in families if c in rows.columns]
    keyed = rows.withColumn("group_key", S.group_key(there, F.col("pdb_id"), F.col("task_id")))
    order = [(F.col("selection_mode") == "fallback").cast("int"), F.desc("keep_prob"), F.desc("score"), sampling.hash_order(F.col("candidate_id"), seed), F.col("candidate_id")]
    out = cut(ordered.capped(keyed, ["group_key"], order, cap, "family_cap"), "capped")
    return sampling.group_split(out.filter("kept"), "group_key", "bin_key", monitor, seed), out.filter("not kept")


def realigned(main: DataFrame, donors: DataFrame, reference: DataFrame, cap: int, ratio: float = 1.0) -> DataFrame:
    """The capped set thinned to the reference's quotas, a row a task protected, and short cells refilled from donors under the cap."""
    cells = cut(density.grid_density(main, binned(reference), AXES), "cells")
    target = max(1, round(main.count() * ratio))
    quotas = cut(density.apportioned(cells, "p_ref", F.lit(target), list(AXES)).select(*AXES, "quota"), "quotas")
    order = [F.desc("keep_prob"), F.desc("score"), F.col("candidate_id")]
    floor = main.withColumn("__protected", F.row_number().over(ordered.over(["task_id"], order)) == 1)
    kept = cut(ordered.thin_to_quota(floor, quotas, list(AXES), F.col("__protected"), order).drop("__protected"), "thinned")
    have = kept.groupBy("bin_key").agg(F.count(F.lit(1)).alias("n"))
    want = quotas.withColumn("bin_key", F.concat_ws("|", *AXES)).join(have, "bin_key", "left").withColumn("deficit", F.col("quota") - F.coalesce("n", F.lit(0))).filter("deficit > 0")
    want = want.withColumn("bin_order", F.col("bin_key"))
    fresh = donors.join(kept.select("candidate_id"), "candidate_id", "left_anti")
    used = kept.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(ordered.refill(fresh, want, "bin_key", "group_key", used, cap, order), allowMissingColumns=True)


def receptor_clusters(rows: DataFrame, sequences: DataFrame, mode: str = "exact") -> DataFrame:
    """Rows with their receptor's key and cluster; ``sequences`` has source_file, receptor, receptor_sequence."""
    keyed = sequences.withColumn("receptor_key", F.concat_ws("|", "source_file", "receptor"))
    make = clusters.exact_clusters if mode == "exact" else clusters.homology_clusters
    return clusters.annotated(rows, keyed.select("source_file", "receptor", "receptor_key"), make(keyed, "receptor_key", "receptor_sequence"), ["source_file", "receptor"], "receptor_key").withColumnRenamed("cluster", "receptor_cluster")


def tracks(rows: DataFrame, atoms: DataFrame, tasks: DataFrame, frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Track A, one flat record a window; track B, ragged arrays of the window's atoms, its cap atoms and the patch's atoms."""
    t = tasks.select("task_id", "source_file", "receptor", "peptide")
    named = structure.caps(frame, rows.drop("has_n_cap", "has_c_cap", "natural_left", "natural_right", "source_file", "receptor", "peptide").join(t, "task_id"))
    patch = structure.patches(frame, structure.residues(atoms), tasks, named)
    a = named.join(patch, "candidate_id", "left")
    own = atoms.withColumnRenamed("chain_id", "peptide").join(named.select("candidate_id", "source_file", "peptide", "left", "right"), ["source_file", "peptide"]).filter("res_index between left and right")
    tag = S.residue_id(F.col("resseq"), F.col("icode"), F.col("resname"))
    flat = own.select("candidate_id", "atom_index", "x", "y", "z", "element", "atom_name", tag.alias("tag"), F.lit(False).alias("is_cap"))
    extra = structure.cap_atoms(atoms, named).select("candidate_id", F.lit(1 << 30).alias("atom_index"), "x", "y", "z", "element", F.col("cap").alias("atom_name"), F.substring("cap", 1, 3).alias("tag"), F.lit(True).alias("is_cap"))
    return a, structure.ragged(flat.unionByName(extra), ["candidate_id"], ["atom_index", "atom_name"])


def reference_set(entries: DataFrame, cutoff: float = 6.0, shortest: int = 4, longest: int = 30, points: int = surface.POINTS) -> DataFrame:
    """Reference rows from atoms of paired files: ``entries`` has entry and atoms' columns, chain ``peptide`` or ``receptor``.

    The peptide chain is the longest one. Rows outside the allowed lengths are left out.
    """
    task = entries.select(F.col("entry").alias("task_id"), F.col("entry").alias("source_file")).distinct().withColumns({"receptor": F.lit("receptor"), "peptide": F.lit("peptide")})
    atoms = entries.drop("source_file").withColumnRenamed("entry", "source_file")
    res = structure.residues(atoms)
    size = structure.chains(res).filter("chain_id = 'peptide'").select("source_file", F.col("n_residues").alias("peptide_length"), F.col("sequence").alias("peptide_sequence"))
    frame = structure.contact_frame(atoms, res, task, cutoff)
    wins = task.join(size, "source_file").filter(F.col("peptide_length").between(shortest, longest)).withColumns({"left": F.lit(0), "right": (F.col("peptide_length") - 1).cast("int")}).withColumn("candidate_id", F.col("task_id"))
    patch = structure.patches(frame, res, task, wins)
    area = surface.window_burial(atoms, task, wins, points=points)
    out = wins.select("candidate_id", "task_id", "peptide_length", "peptide_sequence").join(patch, "candidate_id", "left").join(area, "candidate_id")
    return out.withColumn("pocket_size", F.coalesce("patch_num_residues", F.lit(0))).withColumn("burial", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "burial")))
