import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeflow.operators import clusters, density, greedy, joins, ordered, quality, retrieval, sampling, summary


def sequential(priorities, conflicts):
    order = sorted(range(len(priorities)), key=lambda i: (priorities[i], i))
    near = {i: set() for i in order}
    for a, b in conflicts:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    kept = {}
    for i in order:
        hit = [j for j in kept if j in near[i]]
        if not hit:
            kept[i] = None
    return {i: None if i in kept else min((j for j in near[i] if j in kept), key=lambda j: (priorities[j], j)) for i in order}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_independent_set_equals_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 25)
    priorities = [rng.randint(0, 5) for _ in range(n)]
    conflicts = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 3 * n))]
    rows = spark.createDataFrame(list(enumerate(priorities)), "id int, priority int")
    pairs = spark.createDataFrame(conflicts, "a int, b int")
    got = {r["id"]: (r["kept"], r["by"]) for r in greedy.independent_set(rows, pairs).collect()}
    assert got == {i: (by is None, by) for i, by in sequential(priorities, conflicts).items()}


def test_spaced_positions(spark):
    df = spark.createDataFrame([("t", p, v) for p, v in [(0, 9), (1, 8), (2, 7), (3, 7), (9, 1), (6, 5)]], "k string, p int, v int")
    got = greedy.spaced_positions(df, ["k"], "p", ["-v", "p"], 2, 3).orderBy("rank").collect()
    assert [(r["p"], r["rank"]) for r in got] == [(0, 1), (3, 2), (6, 3)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 50), min_size=1, max_size=9), st.integers(0, 200))
def test_apportionment_sums_and_stays_close(spark, weights, total):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i int, w double")
    got = {r["i"]: r["quota"] for r in density.apportioned(df, "w", F.lit(total), ["i"]).collect()}
    assert sum(got.values()) == total
    assert all(abs(q - weights[i] / sum(weights) * total) < 1 for i, q in got.items())


def test_band_quotas_and_backfill(spark):
    rows = [(f"a{i}", "a", 100 - i) for i in range(10)] + [(f"b{i}", "b", 50 - i) for i in range(2)]
    df = spark.createDataFrame([("t", *r) for r in rows], "t string, id string, band string, score int")
    got = ordered.band_quota_backfill(df, ["t"], "band", {"a": 3, "b": 4}, [F.desc("score"), F.col("id")], 7).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a0", "a1", "a2", "a3", "a4", "b0", "b1"]


def test_refill_stops_at_the_shared_cap(spark):
    donors = spark.createDataFrame([(i, "x" if i < 4 else "y", "g" if i % 2 else "h", 10 - i) for i in range(8)], "id int, bin string, grp string, score int")
    deficits = spark.createDataFrame([("x", 3, 0), ("y", 2, 1)], "bin string, deficit int, bin_order int")
    used = spark.createDataFrame([("g", 1)], "grp string, n long")
    got = ordered.refill(donors, deficits, "bin", "grp", used, 2, [F.desc("score"), F.col("id")])
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_radius_join_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.uniform(-9, 9, (30, 3)), 1), np.round(rng.uniform(-9, 9, (40, 3)), 1)
    frame = lambda m: spark.createDataFrame([("f", i, *map(float, p)) for i, p in enumerate(m)], "f string, i int, x double, y double, z double")
    got = {(r["l_i"], r["r_i"]) for r in joins.radius_join(frame(a), frame(b), ["f"], ["x", "y", "z"], 4.0).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert got == {(int(i), int(j)) for i, j in zip(*np.where(d <= 4.0))}


def test_merge_keeps_the_right_side(spark):
    a = spark.createDataFrame([(1, "l", 1), (2, "l", 2)], "k int, v string, x int")
    b = spark.createDataFrame([(1, "r"), (3, "r")], "k int, v string")
    assert joins.merge_stages(a, b, ["k"]).collect()[0].asDict() == {"k": 1, "v": "r", "x": 1}
    assert joins.merge_report(a, b, ["k"]).first()[:] == (1, 1, 1)


def test_kmer_conflicts_never_cross_lengths_of_kmers(spark):
    rows = [(1, "ABCDEFGHIJ", "M" * 20), (2, "ABCDEFGHIJK", "M" * 20), (3, "ABCDEFGHIX", "M" * 20), (4, "ABCDEFGHIJ", "N" * 20)]
    got = joins.kmer_conflicts(spark.createDataFrame(rows, "id int, s string, l string"), "id", "s", "l").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 3)]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_row_split_is_exact_and_fixed(spark, share):
    df = spark.range(101).toDF("id")
    got = {r["id"]: r["split"] for r in sampling.row_split(df, F.col("id"), share, "s").collect()}
    assert sum(v == "monitor" for v in got.values()) == round(101 * share)
    again = sampling.row_split(df.repartition(7), F.col("id"), share, "s")
    assert {r["id"]: r["split"] for r in again.collect()} == got


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(i, i % 23, "ab"[i % 23 % 2]) for i in range(200)], "id int, g int, cell string")
    rows = sampling.group_split(df, "g", "cell", 0.1).collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values()) and sum(v == {"monitor"} for v in by.values()) == 2


def test_seeded_sample_is_pythons_generator(spark):
    rows = [("task", f"c{i}", 8 if i % 3 else 11, 1.0 + i, i) for i in range(9)] + [("few", "x", 8, 1.0, 0)]
    df = spark.createDataFrame(rows, "t string, id string, n int, w double, i int").repartition(3)
    got = [r["id"] for r in sampling.seeded_sample(df, "t", "w", "n", ["i"]).filter("t = 'task'").orderBy("pick").collect()]
    rng, pool, want = random.Random(20260416 + sum(map(ord, "task"))), list(range(9)), []
    while len(want) < 4:
        others = [i for i in pool if not i % 3]
        among = others if sum(bool(i % 3) for i in want) >= 2 and others else pool
        want.append(rng.choices(among, weights=[1.0 + i for i in among], k=1)[0])
        pool.remove(want[-1])
    assert got == [f"c{i}" for i in want]


def test_weights_jump_at_the_threshold(spark):
    got = spark.createDataFrame([(0.5,), (0.6,), (0.0,)], "c double").select(F.round(sampling.coverage_weight(F.col("c")), 6)).collect()
    assert [r[0] for r in got] == [0.5, 0.1, 0.001]


def test_quality_rules(spark):
    schema = "metadata_error boolean, method string, resolution double, read_error boolean, n_chains int, n_pairs int, area_failed boolean, max_area double"
    rows = [(False, "X-ray diffraction", None, False, 2, 1, False, 300.0), (False, None, None, False, 2, 1, False, 300.0), (False, "X-RAY DIFFRACTION", 3.6, False, 0, 0, False, None), (False, "X-RAY DIFFRACTION", 2.0, False, 1, 0, False, None), (False, "X-RAY DIFFRACTION", 2.0, False, 2, 1, False, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(quality.structure_reason()).collect()]
    assert got == ["passed", "non_xray_method", "low_resolution", "too_few_protein_chains", "small_interface_bsa"]
    pairs = spark.createDataFrame([("f", 0, 100.0), ("f", 1, 250.0), ("f", 2, 900.0)], "f string, i int, v double")
    assert quality.first_sufficient(pairs, ["f"], "i", "v", 200.0).first()[:] == ("f", 1, 250.0)


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert summary.numeric_summary(none, ["x"]).first()[:] == ("x", 0, None, None, None, None, None, None)
    assert summary.numeric_summary(none, ["x"], empty_as_zero=True).first()[:] == ("x", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_homology_clusters_take_the_longest_as_centre(spark):
    df = spark.createDataFrame([("a", "MKTAYIAKQR"), ("b", "MKTAYIAKQRQ"), ("c", "GGGGGSSSSS")], "k string, s string")
    got = {r["k"]: r["cluster"] for r in clusters.homology_clusters(df, "k", "s").collect()}
    assert got["c"] == "c" and got["b"] == "b"


def test_in_batch_loss_against_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4, 4))
    mask = np.zeros((4, 4), bool)
    mask[0, 1] = mask[1, 0] = True
    rows = [(0, i, j, float(z[i, j]), bool(mask[i, j])) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "batch int, query int, item int, score double, m boolean")
    w = np.where(mask, -1e6, z)
    want = np.mean([np.log(np.exp(w[i] - w[i].max()).sum()) + w[i].max() - w[i, i] for i in range(4)])
    assert retrieval.in_batch_loss(df, "batch", F.col("m")).first()["loss"] == pytest.approx(want)
    ranks = retrieval.partner_ranks(df)
    assert retrieval.rank_metrics(ranks).first()["n"] == 4


def test_running_sums_of_groups_of_any_size(spark):
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else "hot" if i % 2 else f"k{i % 7}", rng.randint(0, 30), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    got = {r["id"]: r["rank"] for r in ordered.ranked(df, ["k"], [F.desc("v"), F.col("id")]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want
    upto = {r["id"]: r["s"] for r in ordered.running(df, [], [F.col("id")], F.col("v"), "s").collect()}
    total, sums = 0, {}
    for _, v, i in rows:
        total += v
        sums[i] = total
    assert upto == sums
    assert ordered.ranked(df.limit(0), ["k"], [F.col("id")]).count() == 0


def test_a_hot_group_is_not_ranked_in_one_task(spark):
    """With one group holding all rows, no part that is ranked by itself holds more than a few times its fair share."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).withColumn("k", F.lit("hot"))
        dealt = df.repartitionByRange(F.col("k"), F.col("id")).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 4 and max(r["count"] for r in dealt) < 3 * 20_000 / 4
        assert ordered.ranked(df, ["k"], [F.col("id")]).filter("rank <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_refill_against_a_loop(spark):
    rng = random.Random(4)
    donors = [(f"b{rng.randrange(4)}", f"g{rng.randrange(6)}", rng.randint(0, 9), i) for i in range(80)]
    deficits, used, cap = [("b1", 5, 0), ("b0", 9, 1), ("b3", 30, 2)], [("g0", 3), ("g1", 1)], 4
    have, want = dict(used), set()
    for b, d, _ in deficits:
        for _, g, v, i in sorted((r for r in donors if r[0] == b), key=lambda r: (-r[2], r[3])):
            if d > 0 and have.get(g, 0) < cap:
                want.add(i)
                d, have[g] = d - 1, have.get(g, 0) + 1
    got = ordered.refill(spark.createDataFrame(donors, "b string, g string, v int, i int"), spark.createDataFrame(deficits, "b string, deficit int, bin_order int"), "b", "g", spark.createDataFrame(used, "g string, n int"), cap, [F.desc("v"), F.col("i")])
    assert {r["i"] for r in got.collect()} == want


def test_summary_of_a_hot_value_strings_and_nulls(spark):
    values = [5.0] * 300 + [float(i) for i in range(41)] + [None, float("nan")]
    df = spark.createDataFrame([(v, None if v is None else str(v) if i % 3 else "x", None) for i, v in enumerate(values)], "a double, b string, c double")
    got = {r["column"]: r for r in summary.numeric_summary(df, ["a", "b", "c"]).collect()}
    kept = {"a": values[:-2], "b": [v for i, v in enumerate(values[:-2]) if i % 3]}
    for name, v in kept.items():
        r = got[name]
        assert (r["n"], r["min"], r["max"]) == (len(v), min(v), max(v)) and r["mean"] == pytest.approx(np.mean(v))
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(np.percentile(v, [25, 50, 75])))
    assert got["c"]["n"] == 0 and got["c"]["p50"] is None
    assert summary.numeric_summary(df, ["c"], empty_as_zero=True).first()["p75"] == 0.0


def test_kmer_conflicts_against_all_pairs(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ABCD") for _ in range(n))
    rows = []
    for _ in range(25):
        s, l = word(rng.randint(1, 16)), word(rng.randint(8, 30))
        for _ in range(4):
            edit = lambda x: "".join(rng.choice("ABCD") if rng.random() < 0.06 else c for c in x) + (word(1) if rng.random() < 0.3 else "")
            rows.append((len(rows), edit(s), edit(l)))
    rows += [(len(rows), "", "AB"), (len(rows) + 1, "AB", "")]
    size = lambda s: 3 if len(s) <= 10 else 4
    kmers = lambda s: {s[i : i + size(s)] for i in range(max(1, len(s) - size(s) + 1))}
    same = lambda x, y: sum(p == q for p, q in zip(x, y)) / max(len(x), len(y)) if x and y else 0.0
    for least in (0.85, 0.7):
        want = {(a, b) for a, s, l in rows for b, t, m in rows if a < b and (len(s) <= 10) == (len(t) <= 10) and kmers(s) & kmers(t) and same(s, t) >= least and same(l, m) >= least}
        got = joins.kmer_conflicts(spark.createDataFrame(rows, "id int, s string, l string"), "id", "s", "l", least=least).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 20
