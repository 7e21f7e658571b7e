import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.operators import structure, surface
from latticeflow.plans import buried_windows, contact_windows
from latticeflow.sources import sinks, structures

NAMES = ["ALA", "GLY", "SER", "LEU", "MSE", "VAL"]


def helix(chain, n, shift, seed):
    """A chain of residues whose C and N atoms are 1.33 apart from the next residue's, with a side atom that points about."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = np.array([3.8 * i, 0.0, 0.0]) + shift
        side = base + rng.normal(0, 1, 3) + np.array([1.2, 1.5, 0])
        for atom, element, p in (("N", "N", base), ("CA", "C", base + [1.2, 0.6, 0]), ("C", "C", base + [2.47, 0, 0]), ("O", "O", base + [2.5, -1.2, 0]), ("CB", "C", side), ("H", "H", base + [0, 1, 0])):
            out.append((chain, i + 10, "", NAMES[(i * 7 + seed) % 6], atom, element, *np.round(p, 3)))
    return out


def cif(rows, method="'X-RAY DIFFRACTION'", extra=""):
    head = ["data_TEST", "#", "_entry.id   TEST", f"_exptl.method {method}", extra, "loop_"]
    tags = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num"]
    body = [f"ATOM {k} {e} {a} . {r} {c} {s} {i or '?'} {x} {y} {z} 1.00 20.0 1" for k, (c, s, i, r, a, e, x, y, z) in enumerate(rows)]
    return "\n".join([*head, *(f"_atom_site.{t}" for t in tags), *body, "HETATM 9999 O O . HOH A 500 ? 0 0 0 1 1 1", "#", "loop_", "_other.a", "_other.b", "1 'x y'", ";multi\nline\n;", "2", ""])


ROWS = helix("A", 30, np.array([0.0, 0, 0]), 1) + helix("B", 26, np.array([6.0, 4.5, 1.0]), 2)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("cif")
    (path / "one.cif").write_text(cif(ROWS))
    (path / "nmr.cif").write_text(cif(ROWS, "'SOLUTION NMR'"))
    (path / "low.cif").write_text(cif(ROWS, extra="_refine.ls_d_res_high ?\n_reflns.d_resolution_high '4.10(2)'"))
    (path / "single.cif").write_text(cif(helix("A", 12, np.zeros(3), 3)))
    (path / "broken.cif").write_text("data_x\nloop_\n_atom_site.Cartn_x\n")
    (path / "skip.txt").write_text("x")
    return str(path)


@pytest.fixture(scope="module")
def atoms(spark, folder):
    return structures.atoms(structures.files(spark, folder, "one.cif")).cache()


def test_atoms_of_standard_residues(atoms):
    assert atoms.count() == 56 * 5
    assert {r["chain_id"]: (r["n"], r["m"]) for r in atoms.groupBy("chain_id").agg(F.count_distinct("res_index").alias("n"), F.max("res_index").alias("m")).collect()} == {"A": (30, 29), "B": (26, 25)}
    assert atoms.filter("resname = 'MSE'").count() > 0 and atoms.filter("element = 'H'").count() == 0


def test_metadata_takes_the_first_readable_resolution(spark, folder):
    rows = {r["source_file"]: r for r in structures.metadata(structures.files(spark, folder, "*.cif")).collect()}
    assert rows["low.cif"]["resolution"] == 4.1 and rows["one.cif"]["resolution"] is None
    assert rows["nmr.cif"]["method"] == "SOLUTION NMR" and rows["broken.cif"]["metadata_error"]


def test_exported_text_reads_back(spark, atoms):
    text = sinks.pdb_lines(atoms.withColumnRenamed("chain_id", "chain"), ["source_file"], [F.col("chain_order"), F.col("atom_index")])
    assert text.first()["text"].count("TER") == 2
    back = structures.atoms(text, "pdb")
    same = ["chain_id", "res_index", "resseq", "resname", "atom_name", "element"]
    key = lambda df: sorted(tuple(r) for r in df.select(*same, *(F.round(c, 3) for c in "xyz")).collect())
    assert key(back) == key(atoms)


def test_contacts_against_brute_force(spark, atoms):
    tasks = spark.createDataFrame([("t", "one.cif", "A", "B")], "task_id string, source_file string, receptor string, peptide string")
    rows = atoms.collect()
    a, b = ([r for r in rows if r["chain_id"] == c] for c in "AB")
    near = {}
    for p in b:
        for q in a:
            d = np.sqrt(sum((p[c] - q[c]) ** 2 for c in "xyz"))
            if d <= 6.0:
                near.setdefault(p["res_index"], []).append((q["res_index"], d))
    frame = {r["pep"]: r for r in structure.contact_frame(atoms, structure.residues(atoms), tasks, 6.0).collect()}
    assert len(frame) == 26
    for i, r in frame.items():
        hits = near.get(i, [])
        assert (r["contacts"], r["atom_pairs"]) == (len({q for q, _ in hits}), len(hits))
        assert r["min_distance"] == (pytest.approx(min(d for _, d in hits)) if hits else None)


def test_windows_against_enumeration(spark, atoms):
    tasks = structure.directed_tasks(atoms).cache()
    assert tasks.count() == 2
    wins, frame = contact_windows.candidates(atoms, tasks)
    frames = {}
    for r in frame.collect():
        frames.setdefault(r["task_id"], {})[r["pep"]] = r["contacts"]
    rows = wins.collect()
    assert rows and max(sum(r["task_id"] == t for r in rows) for t in frames) <= 16
    for r in rows:
        counts = [frames[r["task_id"]][i] for i in range(r["left"], r["right"] + 1)]
        assert r["left"] <= r["pep"] <= r["right"] and len(counts) == r["peptide_length"]
        assert r["total_contact_count"] == sum(counts) and r["contact_coverage"] == pytest.approx(np.mean([c > 0 for c in counts]))
        runs = "".join("x" if c else " " for c in counts).split()
        assert r["longest_contact_run"] == max(map(len, runs), default=0)
        assert len(r["peptide_residue_ids"]) == len(r["peptide_sequence"]) == r["peptide_length"]


def test_a_missing_atom_breaks_the_chain(spark, atoms):
    holed = atoms.filter("not (chain_id = 'A' and res_index = 9 and atom_name = 'C')")
    rows = structure.with_continuity(structure.residues(holed)).filter("chain_id = 'A'").orderBy("res_index").collect()
    assert [r["breaks"] for r in rows] == [0] * 10 + [1] * 20
    assert not rows[9]["cap_right"] and not rows[10]["cap_left"] and rows[10]["cap_right"] and not rows[0]["cap_left"]


def test_areas_of_spheres():
    one = surface.accessible_areas(np.zeros((1, 3)), np.array([1.7]))
    assert one[0] == pytest.approx(4 * np.pi * 3.1**2)
    d, r = 3.0, 3.1
    two = surface.accessible_areas(np.array([[0, 0, 0], [d, 0, 0]], float), np.array([1.7, 1.7]), points=4000)
    assert two[0] == pytest.approx(4 * np.pi * r**2 - 2 * np.pi * r * (r - d / 2), rel=0.005)
    far = surface.accessible_areas(np.array([[0, 0, 0], [50, 0, 0]], float), np.array([1.7, 1.7]))
    assert far.sum() == pytest.approx(2 * 4 * np.pi * r**2)
    assert len(surface.accessible_areas(np.zeros((0, 3)), np.zeros(0))) == 0


def test_contact_pipeline(spark, folder):
    out = contact_windows.run(spark, folder, points=60)
    reasons = {r["source_file"]: r["reason"] for r in out["qc"].collect()}
    assert reasons == {"one.cif": "passed", "nmr.cif": "non_xray_method", "low.cif": "low_resolution", "single.cif": "too_few_protein_chains", "broken.cif": "metadata_error"}
    final = out["final"].collect()
    assert final and all(r["patch_num_residues"] == len(r["patch_residue_ids"]) > 0 for r in final)
    assert out["summary"].count() == 4
    assert len({r["candidate_id"] for r in final}) == len(final)


def test_buried_pipeline(spark, atoms):
    tasks = structure.directed_tasks(atoms).cache()
    res = structure.residues(atoms)
    frame = structure.contact_frame(atoms, res, tasks, 6.0).cache()
    wins = buried_windows.windows(frame, structure.contacts(atoms, tasks, 6.0), most_windows=4).cache()
    scored = buried_windows.scored(wins, frame, atoms, tasks, points=60).cache()
    assert scored.count() == wins.count() > 0
    assert scored.filter("burial < 0 or burial > 1 or (prescreen_skipped and burial > 0)").count() == 0
    chosen = buried_windows.selected(buried_windows.without_clones(scored.filter("drop_reason is null")), 5).cache()
    assert 0 < chosen.groupBy("task_id").count().agg(F.max("count")).first()[0] <= 5
    full = chosen.join(tasks.select("task_id", "source_file", "receptor", "peptide", "pdb_id"), "task_id")
    kept, cells = buried_windows.matched(full, scored, 0.5)
    assert kept.count() >= 2 and cells.count() == 36
    main, over = buried_windows.capped_and_split(kept, [], cap=2)
    assert main.count() + over.count() == kept.count() and main.groupBy("group_key").count().filter("count > 2").count() == 0
    flat, ragged = buried_windows.tracks(main, atoms, tasks, frame)
    row = ragged.first()
    assert flat.count() == ragged.count() == main.count() and len(row["coords"]) == len(row["tag"]) == len(row["is_cap"])
