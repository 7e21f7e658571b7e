"""Structure operators over atoms: residues, chains, contacts, directed tasks, anchors, windows, patches and caps.

Atoms are rows; a task is (task_id, source_file, receptor, peptide). All joins are keyed by file or task, distances by grid cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import greedy, joins, ordered

XYZ = ["x", "y", "z"]
RES = ["source_file", "chain_id", "res_index"]
#: Length of a peptide bond in angstrom, from and to; caps allow more.
BOND, CAP_BOND = (1.2, 1.6), (1.2, 1.8)


def residues(atoms: DataFrame) -> DataFrame:
    """One row a residue: ids, letter, and the first C and N atom's coordinates."""
    at = lambda name: F.min_by(F.when(F.col("atom_name") == name, F.struct(*XYZ)), F.when(F.col("atom_name") == name, F.col("atom_index")))
    grouped = atoms.groupBy(*RES).agg(
        F.min("chain_order").alias("chain_order"), F.min("resseq").alias("resseq"), F.min("icode").alias("icode"), F.min_by("resname", "atom_index").alias("resname"),
        F.count(F.lit(1)).alias("n_atoms"), at("C").alias("c"), at("N").alias("n"),
    )
    return grouped.withColumn("residue_id", S.residue_id(F.col("resseq"), F.col("icode"), F.col("resname"))).withColumn("letter", S.one_letter(F.col("resname")))


def bond(left: Column, right: Column, limits: tuple[float, float]) -> Column:
    """Whether the C of ``left`` and the N of ``right`` (structs) are bonded; a missing atom means no."""
    d = S.distance(left["x"], left["y"], left["z"], right["x"], right["y"], right["z"])
    return F.coalesce(d.between(*limits), F.lit(False))


def with_continuity(res: DataFrame) -> DataFrame:
    """``breaks``: the running number of missing backbone bonds; ``cap_left`` and ``cap_right``: bonded neighbours under the wider limit."""
    keys, order = ["source_file", "chain_id"], [F.col("res_index")]
    w = ordered.over(keys, order)
    out = res.withColumn("__pc", F.lag("c").over(w)).withColumn("__nn", F.lead("n").over(w))
    out = ordered.with_breaks(out, keys, order, bond(F.col("__pc"), F.col("n"), BOND))
    return out.withColumn("cap_left", bond(F.col("__pc"), F.col("n"), CAP_BOND)).withColumn("cap_right", bond(F.col("c"), F.col("__nn"), CAP_BOND)).drop("__pc", "__nn")


def chains(res: DataFrame) -> DataFrame:
    """One row a chain: its order, residues, atoms and sequence. A row is one molecule."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("res_index", "letter"))), lambda x: x["letter"])
    return res.groupBy("source_file", "chain_id").agg(F.min("chain_order").alias("chain_order"), F.count(F.lit(1)).alias("n_residues"), F.sum("n_atoms").alias("n_atoms"), F.array_join(listed, "").alias("sequence"))


def contacts(atoms: DataFrame, tasks: DataFrame, radius: float) -> DataFrame:
    """Atom pairs of each task's peptide chain and receptor chain within ``radius``: res_index on both sides and distance."""
    t = tasks.select("task_id", "source_file", "receptor", "peptide")
    side = lambda chain: atoms.select("source_file", F.col("chain_id").alias(chain), "res_index", *XYZ).join(t, ["source_file", chain]).select("task_id", "res_index", *XYZ)
    met = joins.radius_join(side("peptide"), side("receptor"), ["task_id"], XYZ, radius)
    return met.select("task_id", F.col("l_res_index").alias("pep"), F.col("r_res_index").alias("rec"), "distance")


def chain_pairs(atoms: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs of chains with an atom pair within ``radius``: a before b in the file, and the least distance."""
    c = atoms.select("source_file", "chain_id", "chain_order").distinct()
    a, b = c.toDF("source_file", "peptide", "oa"), c.toDF("source_file", "receptor", "ob")
    pairs = a.join(b, "source_file").filter("oa < ob").withColumn("task_id", F.concat_ws("|", "source_file", "peptide", "receptor"))
    near = contacts(atoms, pairs, radius).groupBy("task_id").agg(F.min("distance").alias("pair_min_distance"))
    return pairs.join(near, "task_id").select("source_file", F.col("peptide").alias("a"), F.col("receptor").alias("b"), "pair_min_distance")


def eligible(near: DataFrame, keys: list[str], item: str, least_contacts: int, least_items: int) -> DataFrame:
    """Of contact rows, the keys with enough contacts and enough different items in contact: ``contacts`` and ``items``."""
    counted = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("contacts"), F.count_distinct(item).alias("items"))
    return counted.filter((F.col("contacts") >= least_contacts) & (F.col("items") >= least_items))


def with_masked(pairs: DataFrame, members: DataFrame, keys: list[str], member: str, order: str) -> DataFrame:
    """Adds ``masked``: the members of the pair's structure but ``a`` and ``b``, in order."""
    everyone = members.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, member))), lambda x: x[member]).alias("__all"))
    return pairs.join(everyone, keys).withColumn("masked", F.array_except("__all", F.array("a", "b"))).drop("__all")


def chosen_chain(sizes: DataFrame, keys: list[str], chain: str, order: str, residues: str, hint: str | None = None) -> DataFrame:
    """Per key, the one chain that is the peptide: the one that the column ``hint`` names, else the one with most residues, the first
    of equal ones; chains without residues do not count. Adds ``chain_count``, of all chains."""
    named = F.coalesce(F.col(hint) == F.col(chain), F.lit(False)) if hint else F.lit(False)
    count = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("chain_count"))
    best = ordered.first_of_group(sizes.filter(F.col(residues) > 0), keys, [named.desc(), F.desc(residues), F.col(order), F.col(chain)])
    return best.join(count, keys)


def directed_tasks(atoms: DataFrame, chain_cutoff: float = 6.0, contact_cutoff: float = 6.0, least_contacts: int = 2, least_residues: int = 8) -> DataFrame:
    """Both directions of each contacting pair whose source chain is long enough and touches with enough residues.

    The id is a name-based UUID of entry, pair and direction, so it does not change between runs.
    """
    res = residues(atoms)
    size = chains(res)
    pairs = chain_pairs(atoms, chain_cutoff)
    both = joins.both_directions(pairs, "a", "b")
    both = both.withColumn("pdb_id", F.lower(F.regexp_replace("source_file", r"\.[^.]*$", ""))).withColumn("chain_pair_id", S.pair_id(F.col("a"), F.col("b")))
    both = both.withColumn("direction", S.direction(F.col("peptide"), F.col("receptor")))
    both = both.withColumn("task_id", S.uuid5(F.concat_ws("::", "pdb_id", "chain_pair_id", "direction")))
    near = contacts(atoms, both, contact_cutoff).groupBy("task_id", "pep").agg(F.min("distance").alias("d"))
    ids = res.select("source_file", F.col("chain_id").alias("peptide"), F.col("res_index").alias("pep"), "residue_id")
    touched = near.join(both.select("task_id", "source_file", "peptide"), "task_id").join(ids, ["source_file", "peptide", "pep"])
    touched = touched.groupBy("task_id").agg(F.min("d").alias("source_to_receptor_min_distance"), F.count(F.lit(1)).alias("source_contact_residue_count"), F.transform(F.array_sort(F.collect_list(F.struct("pep", "residue_id"))), lambda x: x["residue_id"]).alias("source_contact_residue_ids"))
    of = lambda role: size.select("source_file", F.col("chain_id").alias(role), F.col("n_residues").alias(f"{role}_n_residues"), F.col("n_atoms").alias(f"{role}_n_atoms"))
    out = both.join(touched, "task_id").join(of("receptor"), ["source_file", "receptor"]).join(of("peptide"), ["source_file", "peptide"])
    out = with_masked(out, size.select("source_file", "chain_order", "chain_id"), ["source_file"], "chain_id", "chain_order")
    out = out.filter((F.col("peptide_n_residues") >= least_residues) & (F.col("source_contact_residue_count") >= least_contacts))
    out = out.withColumnRenamed("masked", "masked_other_chain_ids")
    return out.withColumn("source_contact_residue_fraction", F.col("source_contact_residue_count") / F.col("peptide_n_residues")).drop("a", "b")


def contact_frame(atoms: DataFrame, res: DataFrame, tasks: DataFrame, radius: float) -> DataFrame:
    """Per task and residue of the peptide chain: distinct receptor residues in reach, atom pairs, least distance, continuity.

    Residues without contacts are there with zeros.
    """
    near = contacts(atoms, tasks, radius).groupBy("task_id", "pep").agg(F.count_distinct("rec").alias("contacts"), F.count(F.lit(1)).alias("atom_pairs"), F.min("distance").alias("min_distance"), F.collect_set("rec").alias("touched"))
    chain = with_continuity(res).withColumnRenamed("chain_id", "peptide").withColumnRenamed("res_index", "pep")
    every = tasks.select("task_id", "source_file", "peptide").join(chain, ["source_file", "peptide"])
    out = every.join(near, ["task_id", "pep"], "left")
    return out.withColumns({"contacts": F.coalesce("contacts", F.lit(0)), "atom_pairs": F.coalesce("atom_pairs", F.lit(0)), "touched": F.coalesce("touched", F.array().cast("array<int>"))})


def anchors(frame: DataFrame, seeds: DataFrame | None = None, local_radius: int = 3, least_contacts: int = 2, gap: int = 2, most: int = 3) -> DataFrame:
    """Anchor residues of each task: seeds (task_id, residue_id), or all residues in contact where none of a task's seeds resolves.

    An anchor has enough contacts of its own and a continuous neighbourhood; by contacts, then by the neighbourhood's mean, anchors
    within ``gap`` of a better one go, and ``most`` remain.
    """
    local = ordered.local_frame(frame, ["task_id"], [F.col("pep")], "contacts", local_radius)
    w = ordered.over(["task_id"], [F.col("pep")]).rowsBetween(-local_radius, local_radius)
    local = local.withColumn("__whole", F.min("breaks").over(w) == F.max("breaks").over(w))
    if seeds is not None:
        named = local.join(seeds.select("task_id", "residue_id").withColumn("__seed", F.lit(True)).distinct(), ["task_id", "residue_id"], "left")
        any_ = F.max(F.coalesce("__seed", F.lit(False))).over(ordered.Window.partitionBy("task_id"))
        local = named.withColumn("__ok", F.when(any_, F.coalesce("__seed", F.lit(False))).otherwise(F.col("contacts") > 0)).filter("__ok").drop("__seed", "__ok")
    else:
        local = local.filter("contacts > 0")
    ready = local.filter((F.col("contacts") >= least_contacts) & F.col("__whole"))
    n = frame.groupBy("task_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    picked = ready.join(n, "task_id").select("task_id", "size", "pep", "contacts", "min_distance", "local_avg", "local_coverage", "local_run")
    return greedy.spaced_positions(picked, ["task_id"], "pep", ["-contacts", "-local_avg", "pep"], gap, most)


def windows(frame: DataFrame, picked: DataFrame, shortest: int = 8, longest: int = 20) -> DataFrame:
    """All continuous windows that hold an anchor, one for each pair of bounds (the first anchor's), with contact statistics.

    Statistics come from prefix sums at the bounds, so no window is read residue by residue but for its longest run.
    """
    keys, order = ["task_id"], [F.col("pep")]
    sums = ordered.with_prefix(ordered.with_prefix(frame, keys, order, F.col("contacts"), "__s"), keys, order, (F.col("contacts") > 0).cast("long"), "__h")
    ends = sums.select("task_id", F.col("pep").alias("i"), "contacts", "breaks", "resseq", "icode", "__s", "__h")
    every = ordered.enumerate_windows(picked, "size", "pep", shortest, longest)
    one = ordered.first_of_group(every, ["task_id", "left", "right"], [F.col("rank")])
    a = ends.select("task_id", F.col("i").alias("left"), F.col("breaks").alias("__b0"), (F.col("__s") - F.col("contacts")).alias("__s0"), (F.col("__h") - (F.col("contacts") > 0).cast("long")).alias("__h0"), F.col("resseq").alias("peptide_start_resseq"), F.col("icode").alias("peptide_start_icode"))
    b = ends.select("task_id", F.col("i").alias("right"), F.col("breaks").alias("__b1"), F.col("__s").alias("__s1"), F.col("__h").alias("__h1"), F.col("resseq").alias("peptide_end_resseq"), F.col("icode").alias("peptide_end_icode"))
    whole = one.join(a, ["task_id", "left"]).join(b, ["task_id", "right"]).filter("__b0 = __b1")
    stat = whole.withColumns({"total_contact_count": F.col("__s1") - F.col("__s0"), "avg_contact_count": (F.col("__s1") - F.col("__s0")) / F.col("length"), "contact_coverage": (F.col("__h1") - F.col("__h0")) / F.col("length")})
    flags = frame.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pep", "contacts", "residue_id", "letter"))), lambda x: x).alias("__f"))  # a chain's residues
    part = F.slice("__f", F.col("left") + 1, F.col("length"))
    full = stat.join(flags, "task_id").withColumns({"longest_contact_run": ordered.longest_true(F.transform(part, lambda x: x["contacts"] > 0)), "peptide_residue_ids": F.transform(part, lambda x: x["residue_id"]), "peptide_sequence": F.array_join(F.transform(part, lambda x: x["letter"]), "")})
    return full.drop(*(c for c in full.columns if c.startswith("__"))).withColumnRenamed("length", "peptide_length").withColumn("length_band", S.short_length_band(F.col("peptide_length")))


def patches(frame: DataFrame, res: DataFrame, tasks: DataFrame, wins: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Per window, the receptor residues within reach of any of its residues: ids in chain order, and their number."""
    hit = wins.select(key, "task_id", "left", "right").join(frame.select("task_id", "pep", F.explode("touched").alias("rec")), "task_id").filter("pep between left and right")
    ids = res.select("source_file", F.col("chain_id").alias("receptor"), F.col("res_index").alias("rec"), "residue_id")
    named = hit.select(key, "task_id", "rec").distinct().join(tasks.select("task_id", "source_file", "receptor"), "task_id").join(ids, ["source_file", "receptor", "rec"])
    listed = F.array_sort(F.collect_list(F.struct("rec", "residue_id")))
    return named.groupBy(key).agg(F.transform(listed, lambda x: x["residue_id"]).alias("patch_residue_ids"), F.count(F.lit(1)).alias("patch_num_residues"))


def caps(frame: DataFrame, wins: DataFrame) -> DataFrame:
    """Windows with ``has_n_cap``, ``has_c_cap`` (a bonded neighbour beyond the end) and ``natural_left``, ``natural_right`` termini."""
    n = frame.groupBy("task_id").agg(F.max("pep").alias("__last"))
    a = frame.select("task_id", F.col("pep").alias("left"), F.col("cap_left").alias("has_n_cap"))
    b = frame.select("task_id", F.col("pep").alias("right"), F.col("cap_right").alias("has_c_cap"))
    out = wins.join(a, ["task_id", "left"], "left").join(b, ["task_id", "right"], "left").join(n, "task_id", "left")
    return out.withColumn("natural_left", F.col("left") == 0).withColumn("natural_right", F.col("right") >= F.col("__last")).drop("__last")


def cap_atoms(atoms: DataFrame, wins: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Proxy cap atoms of windows with (key, source_file, peptide, left, right, has_n_cap, has_c_cap): names and coordinates.

    The left neighbour's C, O and CA stand for an acetyl group, the right neighbour's N for an N-methyl group.
    """
    left = S.literal_map({"C": "ACE_C", "O": "ACE_O", "CA": "ACE_CH3"})
    a = atoms.select("source_file", F.col("chain_id").alias("peptide"), "res_index", "atom_name", "atom_index", "element", *XYZ)
    n = wins.filter("has_n_cap").withColumn("res_index", F.col("left") - 1).join(a, ["source_file", "peptide", "res_index"]).withColumn("cap", F.element_at(left, F.col("atom_name")))
    c = wins.filter("has_c_cap").withColumn("res_index", F.col("right") + 1).join(a, ["source_file", "peptide", "res_index"]).withColumn("cap", F.when(F.col("atom_name") == "N", "NME_N"))
    both = n.filter("cap is not null").select(key, "cap", "atom_index", "element", *XYZ).unionByName(c.filter("cap is not null").select(key, "cap", "atom_index", "element", *XYZ))
    return ordered.first_of_group(both, [key, "cap"], [F.col("atom_index")]).drop("atom_index")


def ragged(atoms: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: coordinates (N x 3), elements, names, residue tags and the cap mask, as arrays in one order."""
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *XYZ, "element", "atom_name", "tag", "is_cap")))
    got = atoms.groupBy(*keys).agg(listed.alias("a"))
    return got.select(*keys, F.transform("a", lambda x: F.array(x["x"].cast("float"), x["y"].cast("float"), x["z"].cast("float"))).alias("coords"), *(F.col(f"a.{c}").alias(c) for c in ("element", "atom_name", "tag", "is_cap")))


def backbone_risk(frame: DataFrame, wins: DataFrame) -> DataFrame:
    """``covalent_bias_risk``: half for each end whose chain goes on through a bond (wider limit)."""
    capped = caps(frame, wins)
    return capped.withColumn("covalent_bias_risk", F.col("has_n_cap").cast("double") * 0.5 + F.col("has_c_cap").cast("double") * 0.5)
