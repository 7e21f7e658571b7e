import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from latticeflow.llm import phrase_index as P


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, width=10):
    out = []
    for d in docs:
        w = words(d)
        hit, found = set(), set()
        for key, item in items:
            v = words(item)
            for i in range(max(0, len(v) - width) + 1 if v else 0):
                g = v[i : i + width]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found |= {key}
        listed = sorted(str(k) for k in found if k is not None)
        out.append((len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    rng = random.Random(8)
    vocabulary = ["the", "of", "Ça", "été", "x1", "été2", "word", "rare", "More", "straße", "日本", "ab", "cd"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (20, text(12)), (3, "Short rare-item"), (4, ""), (5, None), (None, text(11)), (3, text(10)), (7, "one unseen " + text(9))]
    docs = [None, "", "...", "short RARE item", "item short rare", text(400)]
    for _ in range(25):
        t = rng.choice([t for _, t in items if t]).split()
        a = rng.randint(0, max(0, len(t) - 10))
        docs.append(text(rng.randint(0, 20)) + ", " + ";".join(t[a : a + rng.randint(8, 14)]) + " " + text(rng.randint(0, 9)))
    return docs + docs[-2:], items


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, n_hit long")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(P.search(d, b, **more).collect(), key=lambda r: r["doc_id"])
    return [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows]


def test_equals_brute_force(spark):
    docs, items = fixture()
    assert run(spark, docs, items) == brute(docs, items)


def test_shuffled_joins_find_the_same(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(P, "join_checked", lambda left, right, on, how, rows, most=0: left.join(right.hint("shuffle_hash"), on, how))
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture()
    assert run(spark, [], items) == []
    assert run(spark, docs[:6], []) == brute(docs[:6], [])


def near(docs, items, width=10, within=P.WITHIN):
    split = [words(d) for d in docs]
    counts = {}
    for w in split:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    out = []
    for w in split:
        found = set()
        for key, item in items:
            v = words(item)
            for i in range(max(0, len(v) - width) + 1 if v else 0):
                g = v[i : i + width]
                if all(x in counts for x in g):
                    rarest = min((counts[x], k, x) for k, x in enumerate(g))[2]
                    if any(x == rarest and set(g) <= set(w[max(0, p - within) : p + within + 1]) for p, x in enumerate(w)):
                        found.add(key)
        out.append(len(found - {None}))
    return out


@pytest.mark.parametrize("within", [2, 5, 15])
def test_proximity_equals_brute_force(spark, within):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in P.search(d, b, within=within).collect()}
    want = near(docs, items, within=within)
    assert [got[i] for i in range(len(docs))] == want and (within < 15 or sum(want))


def test_postings_are_stored_once_for_all_terms(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "c A-b")], "doc_id long, text string")
    rows = P.stored(docs, spark.createDataFrame([("a",), ("b",)], "term string"), "text", ["doc_id"]).collect()
    at = {r["uid"]: r["kept"]["c0"] for r in rows if r["term"] == P.END}
    assert sorted((at[r["uid"]], r["term"], r["pos"]) for r in rows) == [(1, P.END, 3), (1, "a", 1), (1, "b", 0), (1, "b", 2), (2, P.END, 0), (3, P.END, 3), (3, "a", 1), (3, "b", 2)]


def test_clashing_names_and_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(10))
    d = spark.createDataFrame([(1, "x " * 200_000 + item, 5, 6), (2, "x", 7, 8)], "doc_id long, text string, uid int, term int")
    got = P.search(d, spark.createDataFrame([(1, item)], "item_id long, text string"), keep=[F.col("doc_id"), F.col("uid"), F.col("term")])
    assert sorted((r["doc_id"], r["uid"], r["term"], r["n_words"], r["n_hit"]) for r in got.collect()) == [(1, 5, 6, 200_010, 10), (2, 7, 8, 1, 0)]
