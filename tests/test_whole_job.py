"""Registered queries against brute force where their SQL looks at a part of the job only."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from latticeflow import storage
from latticeflow.operators import greedy, joins, retrieval
from latticeflow.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def rows(text):
    return duckdb.sql(text.replace("TABLES", SMALL)).fetchall()


def test_prefix_windows_of_every_length(spark):
    flags = {}
    for user, value in rows("select user_id, value from 'TABLES/events.parquet' order by user_id, ts, event_id"):
        flags.setdefault(user, []).append(int(value // 1) % 4 > 0)
    want = [(u, i, n, sum(f[i : i + n])) for u, f in flags.items() for n in range(8, 21) for i in range(len(f) - n + 1) if sum(f[i : i + n]) / n >= 0.9]
    got = catalogue.queries()["prefix_window_count"](spark, SMALL).select("user_id", "left_index", "length", "contacts").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[2] for r in want} == set(range(8, 21))


def test_anchored_windows_of_every_length(spark):
    want = []
    for (u,) in rows("select c_custkey from 'TABLES/customer.parquet'"):
        n, a = u % 40 + 8, u % 7 + 4
        want += [(u, i, i + k - 1, k) for k in range(8, 21) for i in range(n - k + 1) if i <= a <= i + k - 1]
    got = catalogue.queries()["window_enumerate"](spark, SMALL).select("id", "left", "right", "length").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def kmer_pairs(parts):
    def kmers(s):
        k = 3 if len(s) <= 10 else 4
        return {(k, s[i : i + k]) for i in range(max(1, len(s) - k + 1))}

    same = lambda x, y: sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))
    out = {}
    for a, s, m, _ in parts:
        for b, t, n, _ in parts:
            if a < b and kmers(s) & kmers(t) and same(s, t) >= 0.85 and same(m, n) >= 0.85:
                out[a, b] = (round(same(s, t), 6), round(same(m, n), 6))
    return out


def test_kmer_pairs_and_greedy_choice_on_whole_strings(spark):
    parts = rows("select p_partkey, upper(replace(p_name || p_type, ' ', '')), upper(p_name) || p_brand || cast(p_size as varchar), p_retailprice from 'TABLES/part.parquet'")
    want = kmer_pairs(parts)
    got = catalogue.queries()["kmer_block_dup"](spark, SMALL).collect()
    assert {(r["a"], r["b"]): (r["short_identity"], r["long_identity"]) for r in got} == want and len(got) == len(want)
    assert want != kmer_pairs([(i, s[:12], m, w) for i, s, m, w in parts])

    kept, by = [], {}
    for i, _, _, _ in sorted(parts, key=lambda p: (-p[3], p[0])):
        by[i] = next((k for k in kept if (min(i, k), max(i, k)) in want), None)
        if by[i] is None:
            kept.append(i)
    got = catalogue.queries()["greedy_dedup"](spark, SMALL).collect()
    assert {r["id"]: (r["kept"], r["by"]) for r in got} == {i: (b is None, b) for i, b in by.items()}


def test_ranks_of_every_pair(spark):
    vectors = dict(rows("select vec_id, embedding from 'TABLES/embeddings.parquet'"))
    left, right = ({v // 2: list(map(float, e)) for v, e in vectors.items() if v % 2 == side} for side in (0, 1))
    ranks = []
    for q in sorted(left.keys() & right.keys()):
        scores = {i: sum(x * y for x, y in zip(left[q], e)) for i, e in right.items()}
        ranks.append(1 + sum(s > scores[q] or (s == scores[q] and i < q) for i, s in scores.items()))
    n = len(ranks)
    got = catalogue.queries()["retrieval_rank"](spark, SMALL).collect()[0]
    assert (got["n"], got["median_rank"]) == (n, sorted(ranks)[(n + 1) // 2 - 1])
    assert abs(got["mean_rank"] - sum(ranks) / n) < 1e-5 and abs(got["mrr"] - sum(1 / r for r in ranks) / n) < 1e-5
    assert all(abs(got[f"recall_at_{k}"] - sum(r <= k for r in ranks) / n) < 1e-5 for k in (1, 5, 10))


def with_copies(spark, path, copies):
    """The smallest parts ``copies`` times with shifted keys, some without a price, a name or a type."""
    parts = spark.read.parquet(f"{SMALL}/part.parquet")
    many = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("i")).drop("i")
    odd = F.col("p_partkey") % 97
    many = many.withColumns({"p_retailprice": F.when(odd != 5, F.col("p_retailprice")), "p_name": F.when(odd == 6, "").when(odd != 7, F.col("p_name")), "p_type": F.when(odd == 6, "").otherwise(F.col("p_type"))})
    many.write.parquet(f"{path}/part.parquet")
    return rows_of(f"{path}/part.parquet/*.parquet")


def rows_of(path):
    text = "select p_partkey, upper(replace(p_name || p_type, ' ', '')), upper(p_name) || p_brand || cast(p_size as varchar), p_retailprice from"
    return duckdb.sql(f"{text} '{path}'").fetchall()


@pytest.mark.parametrize("members", [1000, 2])
def test_copies_are_met_as_classes(spark, tmp_path, monkeypatch, members):
    """Each class of equal sequences is compared once, its pairs are spelt out from lists; null and empty sequences meet nothing."""
    monkeypatch.setattr(joins, "MEMBERS", members)
    compared = []
    inner = joins.class_conflicts
    monkeypatch.setattr(joins, "class_conflicts", lambda classes, *a: compared.append(classes.count()) or inner(classes, *a))
    parts = with_copies(spark, str(tmp_path), 3)
    alike = [p for p in parts if p[1] and p[2]]
    want = kmer_pairs(alike)
    got = catalogue.queries()["kmer_block_dup"](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]): (r["short_identity"], r["long_identity"]) for r in got} == want and len(got) == len(want)

    kept, by = [], {}
    for i, *_ in sorted(parts, key=lambda p: (p[3] is None, -(p[3] or 0), p[0])):
        by[i] = next((k for k in kept if (min(i, k), max(i, k)) in want), None)
        if by[i] is None:
            kept.append(i)
    got = catalogue.queries()["greedy_dedup"](spark, str(tmp_path)).collect()
    assert {r["id"]: (r["kept"], r["by"]) for r in got} == {i: (b is None, b) for i, b in by.items()} and len(got) == len(parts)
    assert compared == [len({p[1:3] for p in alike})] * 2


@pytest.mark.parametrize("broadcast", [48 << 20, 0])
def test_ranks_come_from_blocks_not_from_a_row_a_pair(spark, monkeypatch, broadcast):
    """Ties that only the order of addition settles, copies, repeated ids, missing values and NaN, against adding one by one."""
    monkeypatch.setattr(retrieval, "LEAST_BLOCK", 8)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(retrieval, "similarity", None)
    rng = random.Random(4)
    plain = [(i, [rng.choice([0.1, 0.2, 0.3, -0.7, 1e8]) for _ in range(6)]) for i in range(60)]
    odd = [(60, None), (61, []), (62, [None] * 6), (63, [float("nan")] * 6), (64, [0.1, None, 3.0]), (65, [0.1] * 8), (66, [float("inf")] * 6), (7, [0.3] * 6)]
    for queries, items in ((plain, [(i, list(reversed(v))) for i, v in plain]), (plain + odd, [*plain, *odd, (500, [0.2] * 6)])):

        def score(a, b):
            parts = [x * y for x, y in zip(a or [], b or []) if x is not None and y is not None]
            total = 0.0
            for p in parts:
                total += p
            return (math.isnan(total), 0 if math.isnan(total) else total) if parts else None

        want = {}
        for i, _ in queries:
            own = [score(a, b) for j, a in queries if j == i for k, b in items if k == i]
            scores = [(score(a, b), k) for j, a in queries if j == i for k, b in items]
            want[i] = 1 + sum(s is not None and t is not None and (s > t or s == t and k < i) for t in own for s, k in scores)
        frames = [spark.createDataFrame(rows, "id long, v array<double>") for rows in (queries, items)]
        got = retrieval.block_ranks(*frames, "id", "id", "v", "v").collect()
        assert {r["query"]: r["rank"] for r in got} == want and len(got) == len(want)
    assert retrieval.block_ranks(frames[0].limit(0), frames[1].limit(0), "id", "id", "v", "v").count() == 0


@pytest.mark.parametrize("name", ["kmer_block_dup", "greedy_dedup"])
def test_sides_of_unknown_size_are_not_broadcast(spark, monkeypatch, name):
    """Only the hot keys of ``join_counted``, which are bounded in number, go through the driver, however small Spark takes a side to be."""
    sent = []

    def watched(df, what, inner=storage.cut):
        sent.append((what, df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")))
        return inner(df, what)

    monkeypatch.setattr(joins, "cut", watched)
    monkeypatch.setattr(greedy, "cut", watched)
    watched(catalogue.queries()[name](spark, SMALL), "result")
    assert {what for what, n in sent if n} <= ({"members"} if name == "kmer_block_dup" else {"firsts", "result"}) and len(sent) > 4


@pytest.mark.parametrize("points", [8192, 3])
def test_nearest_come_from_lists_not_from_a_row_a_pair(spark, monkeypatch, points):
    """Ties, copies, repeated and null ids, and missing coordinates, against comparing one by one; no side is broadcast."""
    monkeypatch.setattr(joins, "LEFT_POINTS", points)
    monkeypatch.setattr(joins, "RIGHT_POINTS", points)
    monkeypatch.setattr(joins, "radius_join", None)
    rng = random.Random(6)
    place = lambda: float(rng.choice([-3, -1, 0, 1, 2, 4, 7.5]))
    some = lambda n: [(i, rng.choice("ab"), place(), place()) for i in range(n)]
    odd = [(None, "a", 0.0, 0.0), (3, "a", 1.0, 1.0), (90, None, 0.0, 0.0), (91, "a", None, 0.0), (92, "a", float("nan"), 0.0), (93, "b", float("inf"), 0.0), (94, "c", 0.0, 0.0)]
    left, right = some(40) + odd, some(60) + odd[:-1]
    want = {}
    for i, g, x, y in left:
        for j, h, u, v in right:
            if None not in (g, x, u) and g == h and (d := math.sqrt((x - u) * (x - u) + (y - v) * (y - v))) <= 2:
                n, best = want.get(i, (0, (math.inf, True, 0)))
                want[i] = n + 1, min(best, (d, j is None, j or 0))
    frames = [spark.createDataFrame(rows, "id long, g string, x double, y double") for rows in (left, right)]
    got = joins.radius_nearest(*frames, ["g"], ["x", "y"], 2.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    assert {r["id"]: (r["near"], (r["min_distance"], r["nearest"] is None, r["nearest"] or 0)) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("broadcast", [48 << 20, 0])
def test_best_items_come_from_blocks_not_from_a_row_a_pair(spark, tmp_path, monkeypatch, broadcast):
    """Copies, ties, zeros, missing values, NaN and vectors of other lengths, against the SQL."""
    monkeypatch.setattr(retrieval, "LEAST_BLOCK", 8)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(retrieval, "similarity", None)
    rng = random.Random(8)
    vectors = [(50 * i, [rng.choice([0.1, 0.2, 0.3, -0.7]) for _ in range(5)]) for i in range(120)]
    vectors += [(7 * i + 1, [0.1, 0.2, 0.3, 0.1, 0.3]) for i in range(40)] + [(i, None) for i in (6, 100_000)] + [(13, []), (200_000, [None] * 5), (300_000, [0.1, None, 0.3])]
    odd = [(400_000, [0.0] * 5), (500_001, [0.1] * 7), (600_000, [float("nan")] * 5), (700_000, [1e-30] * 5), (800_000, [3e38] * 5)]
    for k, rows in enumerate((vectors[:160], vectors, vectors + odd)):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/{k}/embeddings.parquet/*.parquet'")
        shown = lambda r: (r[0], r[1], r[2], None if r[3] is None else "nan" if math.isnan(r[3]) else round(r[3], 5) + 0.0)
        want = sorted(map(shown, con.execute("select query, item, rank, score from (" + catalogue.oracle_sql()["cosine_topk"] + ")").fetchall()), key=lambda r: (r[0], r[2]))
        got = catalogue.queries()["cosine_topk"](spark, f"{tmp_path}/{k}").select("query", "item", "rank", "score").collect()
        assert sorted(map(shown, got), key=lambda r: (r[0], r[2])) == want
