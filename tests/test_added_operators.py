"""Operators on errors, selections, references, losses and run totals, each against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from latticeflow.functions import scalars as S
from latticeflow.operators import joins, ordered, quality, retrieval, sampling, structure, summary
from latticeflow.sources import sinks, structures, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_first_generation_reasons(spark):
    base = dict(exception=None, metadata_error=None, method="X-ray diffraction", resolution=2.0, parse_error=False, assembly_error=None, n_chains=3, n_pairs=2, passing_area=250.0)
    cases = {
        "pass": {}, "metadata_error:KeyError": {"metadata_error": "KeyError"}, "non_xray_method": {"method": None}, "low_resolution": {"resolution": 3.6},
        "parse_error": {"parse_error": True, "n_chains": None}, "assembly_error:ValueError": {"assembly_error": "ValueError"}, "empty_structure": {"n_chains": 0},
        "insufficient_chain_instances": {"n_chains": 1}, "no_contacting_chain_pairs": {"n_pairs": 0}, "delta_sasa_failed": {"passing_area": None},
        "low_interface_buried_area": {"passing_area": 199.9}, "exception:TypeError": {"exception": "TypeError"},
    }
    schema = "exception string, metadata_error string, method string, resolution double, parse_error boolean, assembly_error string, n_chains int, n_pairs int, passing_area double"
    rows = frame(spark, [tuple((base | change).values()) for change in cases.values()], schema)
    assert [r[0] for r in rows.select(quality.first_generation_reason()).collect()] == list(cases)
    missing = frame(spark, [tuple((base | {"resolution": None}).values())], schema)
    assert missing.select(quality.first_generation_reason()).first()[0] == "pass"


def test_the_scan_stops_at_the_first_sufficient_pair(spark):
    pairs = [("a", 0, 150.0), ("a", 1, 220.0), ("a", 2, 900.0), ("b", 0, 10.0), ("b", 1, 90.0), ("b", 2, 90.0), ("c", 0, None)]
    got = quality.passing_pair(frame(spark, pairs, "f string, i int, area double"), ["f"], "i", "area")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 220.0), ("b", 1, 90.0)]


def test_windows_that_do_not_fit_become_errors(spark):
    rows = [(0, 3, 9, "ABCD"), (None, 3, 9, "A"), (0, 3, None, "ABCD"), (6, 9, 9, "ABCD"), (-1, 2, 9, "ABCD"), (3, 2, 9, ""), (0, 0, 9, None), (0, 4, 9, "ABCD")]
    good, bad = sinks.dead_letters(frame(spark, rows, "start int, end int, n_residues int, sequence string"), quality.window_error())
    assert good.count() == 1
    assert sorted(r["error"] for r in bad.collect()) == sorted(["missing window indices", "missing chain", "window out of bounds", "window out of bounds", "window out of bounds", "empty window", "window bounds mismatch"])


def test_files_that_cannot_be_parsed_are_rows_with_their_error(spark):
    fine = "ATOM      1  CA  GLY A   1       1.000   2.000   3.000  1.00  0.00           C\n"
    bad = fine.replace("   1.000", "   x.000")
    rows = structures.parsed(frame(spark, [("a.pdb", fine), ("b.pdb", bad), ("c.pdb", None)], "source_file string, text string"), "pdb").cache()
    assert [(r["source_file"], r["x"]) for r in structures.good(rows).collect()] == [("a.pdb", 1.0)]
    (why,) = structures.failed(rows).collect()
    assert (why["source_file"], why["type"]) == ("b.pdb", "ValueError") and "x.000" in why["message"] and "Traceback" in why["traceback"]
    assert structures.good(rows).columns == [c.split()[0] for c in structures.ATOMS.split(", ")]


def test_splits_entities_contexts_and_limits(spark):
    df = frame(spark, [("train", "AB", "x", "1ABC", "A"), ("train", " ", "x", "1abc", "B"), ("val", "AB", "x", "2def", "A"), ("train", "A", None, "1abc", "A")], "split string, s string, r string, pdb_id string, chain string")
    assert [r["pdb_id"] for r in tables.split_rows(df, "train", "s", "r").collect()] == ["1ABC"]
    assert tables.entity_rows(df, " 1abc ").count() == 3 and tables.entity_rows(df, "1ABC", {"chain": "B"}).count() == 1 and tables.entity_rows(df, "1abc", {"chain": ""}).count() == 3
    assert tables.require_same(df.filter("chain = 'A'"), "chain").count() == 3
    with pytest.raises(ValueError, match="chain"):
        tables.require_same(df, "chain")
    assert tables.first_rows(df, [F.col("pdb_id"), F.col("chain")], 2).count() == 2 and tables.first_rows(df, [], None).count() == 4


def test_index_and_manifest(spark, tmp_path):
    frame(spark, [(1, [1.0]), (2, [2.0])], "id int, v array<double>").write.parquet(str(tmp_path / "v"))
    frame(spark, [(1, "a")], "id int, page string").write.parquet(str(tmp_path / "m"))
    assert sorted((r["id"], r["page"]) for r in tables.read_index(spark, str(tmp_path / "v"), str(tmp_path / "m")).collect()) == [(1, "a"), (2, None)]
    sinks.write_manifest(frame(spark, [(1, "f.pdb")], "i int, file string"), str(tmp_path / "out"), "One file an interface.")
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/manifest.jsonl")).collect()] == [{"i": 1, "file": "f.pdb"}]
    assert spark.read.text(str(tmp_path / "out/README.txt")).first()["value"] == "One file an interface."


def test_peptide_chain(spark):
    sizes = frame(spark, [("e", "A", 0, 5, "C"), ("e", "B", 1, 9, "C"), ("e", "C", 2, 3, "C"), ("f", "A", 0, 7, "Z"), ("f", "B", 1, 7, "Z"), ("g", "A", 0, 0, None)], "entry string, chain string, o int, n int, hint string")
    got = {r["entry"]: (r["chain"], r["chain_count"]) for r in structure.chosen_chain(sizes, ["entry"], "chain", "o", "n", "hint").collect()}
    assert got == {"e": ("C", 3), "f": ("A", 2)}
    assert {r["entry"]: r["chain"] for r in structure.chosen_chain(sizes, ["entry"], "chain", "o", "n").collect()} == {"e": "B", "f": "A"}


def cross_entropy(logits):
    return sum(math.log(sum(math.exp(z) for z in row)) - row[i] for i, row in enumerate(logits)) / len(logits)


def test_symmetric_loss_crosses_its_masks(spark):
    rng = random.Random(1)
    n, receptors, peptides = 6, ["r0", "r0", "r1", "r2", "r2", "r3"], ["p0", "p1", "p1", "p2", "p3", "p4"]
    z = [[rng.uniform(-2, 2) for _ in range(n)] for _ in range(n)]
    masked = lambda m, keys: [[-1e6 if i != j and keys[i] == keys[j] else m[i][j] * 2.5 for j in range(n)] for i in range(n)]
    turned = [[z[j][i] for j in range(n)] for i in range(n)]
    want = 0.5 * cross_entropy(masked(z, peptides)) + 0.5 * cross_entropy(masked(turned, receptors))
    rows = [(0, i, j, z[i][j], receptors[i], receptors[j], peptides[i], peptides[j]) for i in range(n) for j in range(n)]
    scores = frame(spark, rows, "batch int, query int, item int, score double, r string, r_of_item string, p string, p_of_item string")
    got = retrieval.symmetric_loss(scores, "batch", "r", "p", scale=2.5).first()
    assert got["n"] == n and got["loss"] == pytest.approx(want)
    assert [r[0] for r in frame(spark, [(0.0,), (math.log(3),), (50.0,)], "s double").select(S.clamped_scale(F.col("s"))).collect()] == pytest.approx([1.0, 3.0, 100.0])


def test_weighted_mean_common_values_and_unions(spark):
    df = frame(spark, [(1.0, 10), (4.0, 30)], "loss double, n int")
    assert tuple(summary.weighted_mean(df, "loss", "n").first()) == (3.25, 40) and summary.weighted_mean(df.limit(0), "loss", "n").first()["mean"] == 0.0
    places = frame(spark, [(1, 9), (1, 9), (2, 8), (0, 5)], "left int, right int")
    assert [tuple(r) for r in summary.most_common(places, ["left", "right"], 2).collect()] == [(1, 9, 2), (0, 5, 1)]
    patches = frame(spark, [("t", 2, [7, 3]), ("t", 1, [5, 7, 5]), ("u", 1, [])], "t string, i int, p array<int>")
    assert [tuple(r) for r in ordered.distinct_union(patches, ["t"], [F.col("i")], "p").collect()] == [("t", [5, 7, 3])]


def test_run_totals(spark):
    windows = [("a", 1.0, i < 2, i >= 3, 0.5 if i % 2 else None, i, True, True) for i in range(9)] + [("b", 3.0, False, False, None, None, False, True)]
    chosen = [("a", 1.0, 9, "sampled", True, True), ("a", 1.0, 12, "sampled", True, False), ("b", 3.0, 20, "filled", False, True)]
    got = summary.run_totals(
        frame(spark, windows, "task_id string, score double, duplicate boolean, eligible boolean, burial double, pocket_size int, hit_left boolean, hit_right boolean"),
        frame(spark, chosen, "task_id string, score double, peptide_length int, stage string, hit_left boolean, hit_right boolean"),
    ).first().asDict()
    want = {
        "num_parent_tasks": 2, "total_candidates_before": 10, "total_redundant_dropped": 2, "total_eligible_after_dedup": 6, "tasks_truncated": 1, "total_topk_dropped": 3,
        "tasks_with_no_eligible_pool": 1, "tasks_with_sampling_active": 1, "mean_score_before": 1.2, "burial_present_count": 4, "pocket_size_present_count": 9,
        "total_candidates_after": 3, "total_sampled_from_eligible": 2, "total_filled_by_fallback": 1, "final_both_cap_count": 1, "length_8_10": 1, "length_11_14": 1, "length_15_20": 1,
        "avg_candidates_before": 5.0, "avg_candidates_after": 1.5, "burial_present_ratio": 0.4,
    }
    assert {k: got[k] for k in want} == pytest.approx(want) and got["final_both_cap_ratio"] == pytest.approx(1 / 3)


def test_page_references(spark):
    pages = [("Home.md", "P1"), ("guide/Home.md", "P2"), ("me.md", "P3"), ("API", "P4")]

    def look(raw):
        text = (raw or "").strip()
        known = dict(pages)
        tries = [p for p in reversed([x.strip() for x in text.split("|") if x.strip()])] + [text] if "|" in text else [text]
        for t in tries:
            if not t:
                return None
            if t in known:
                return known[t]
            for k, v in pages:
                if t.endswith(k):
                    return v
        return None

    refs = ["Home.md", "docs/Home.md", "x | API", "API | nothing", "a|guide/Home.md", "", None, " API ", "zzz", "|", "theme.md", "q|theme.md|"]
    got = joins.page_references(frame(spark, [(i, r) for i, r in enumerate(refs)], "i int, ref string"), "ref", frame(spark, [(k, v, i) for i, (k, v) in enumerate(pages)], "k string, v string, o int"), "k", "v", "o")
    assert {r["i"]: r["found"] for r in got.collect()} == {i: look(r) for i, r in enumerate(refs)}


def test_batches_hold_each_row_once_and_follow_the_seed(spark):
    df = spark.range(53)
    one = sorted((r["batch"], r["place"], r["id"]) for r in sampling.batches(df, F.col("id"), 10, "s").collect())
    assert [b for b, _, _ in one] == sorted([i // 10 for i in range(53)]) and sorted(i for _, _, i in one) == list(range(53))
    assert one == sorted((r["batch"], r["place"], r["id"]) for r in sampling.batches(df.repartition(7), F.col("id"), 10, "s").collect())
    assert one != sorted((r["batch"], r["place"], r["id"]) for r in sampling.batches(df, F.col("id"), 10, "t").collect())
