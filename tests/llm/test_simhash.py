import random

import pytest
from pyspark.sql import functions as F

from latticeflow.llm import simhash as S


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_components(prints):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(find(p), i)
    return [least[find(p)] for p in prints]


def drifting():
    rng = random.Random(3)
    prints = [0, 0, 1, 3, 1 << 63, (1 << 64) - 1, (1 << 64) - 4]
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):  # drifting groups: chains of near copies
            prints.append(p)
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
    return prints


@pytest.mark.parametrize("segments, light", [(1, 16), (2, 16), (2, 1), (3, 2), (4, 1), (7, 16)])
def test_components_equal_all_pairs(spark, monkeypatch, segments, light):
    monkeypatch.setattr(S, "LIGHT", light)
    prints = drifting()
    df = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "doc_id long, fp long").cache()
    got = {r["doc_id"]: r["component"] for r in S.near_groups(df, segments=segments).collect()}
    assert [got[i] for i in range(len(prints))] == brute_components(prints)


def test_segments_change_the_plan_only(spark):
    df = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(set(drifting()))], "doc_id long, fp long").cache()
    plans = {n: S.links(df.select("fp"), segments=n)._jdf.queryExecution().toString() for n in (2, 4)}
    assert len(set(plans.values())) == 2
    with pytest.raises(ValueError):
        S.links(df, most_bits=3)


def test_a_heavy_value_is_not_listed_in_pairs(spark):
    """Fingerprints that share half their bits, all within two bits of one: as many links as fingerprints, times the balls' size."""
    prints = [0] + [1 << a | 1 << b for a in range(32) for b in range(a)]
    found = S.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r["u"] for r in found.collect()} | {r["v"] for r in found.collect()}
    assert got == set(prints) and found.count() < 40 * len(prints)


def jaccard(a, b, width=5):
    x, y = (set(S.shingles(t, width)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def text_groups(texts, least=0.8):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [set(S.shingles(t, 5)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) >= least * union - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_similar_texts_are_linked_and_others_are_not(spark):
    rng = random.Random(6)
    texts = [None, "", " \t", "one two three", "One Two  three", "one two four"]
    for _ in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 300))]
        texts += [edited(rng, words, rng.randint(0, len(words) // 60)) for _ in range(rng.randint(1, 4))]
        texts.append(edited(rng, words, len(words) // 8))  # too many edits
    got = {r["order"]: r["component"] for r in S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").cache()).collect()}
    want = text_groups(texts)
    together = lambda of: {(i, j) for i in range(len(texts)) for j in range(i) if of[i] == of[j]}
    a, b = together([got[i] for i in range(len(texts))]), together(want)
    assert a <= b and len(a) >= 0.9 * len(b) > 30


@pytest.mark.parametrize("segment_bits, common", [(28, 3), (32, 10**9), (28, 1)])
def test_no_link_is_left_out(spark, monkeypatch, segment_bits, common):
    """Pairs just over the threshold, of texts of unlike lengths too, a crowd of near copies, and a passage that many share."""
    monkeypatch.setattr(S, "COMMON", common)
    rng = random.Random(9)
    passage, crowd = ([f"p{i}" for i in range(40)], [f"c{i}" for i in range(120)])
    texts = [" ".join(passage + [f"own{i}x{j}" for j in range(rng.randint(1, 12))]) for i in range(40)]
    texts += [edited(rng, crowd, rng.randint(0, 4)) for _ in range(40)]
    for i in range(150):
        words = [f"t{i}w{j}" for j in range(rng.randint(45, 200))]
        shingled = len(words) - 4
        lost = int(shingled / 9 / 5)  # that many edits, each in five shingles, leave a similarity of 0.8 or a little more
        at = rng.sample(range(5, len(words) - 5, 10), min(lost, len(words) // 10 - 1))
        texts += [" ".join(words), " ".join(f"e{i}x{j}" if j in at else w for j, w in enumerate(words)), " ".join(words[: int(len(words) * 0.81)])]
    got = {r["order"]: r["component"] for r in S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").cache(), segment_bits=segment_bits).collect()}
    assert [got[i] for i in range(len(texts))] == text_groups(texts)


def shuffled(spark, since=0):
    """Bytes that the stages from number ``since`` on wrote for shuffles, and the next stage's number."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(i) for i in range(stages.size()))]
    return sum(n for i, n in rows if i >= since), max((i for i, _ in rows), default=-1) + 1


def test_prefixes_and_sets_are_shuffled_in_little_space(spark):
    """Long texts, each with a neighbour of half its shingles: their prefixes meet, and no set has to be moved."""
    rng = random.Random(12)
    texts = []
    for i in range(150):
        words = [f"{rng.getrandbits(24):06x}" for _ in range(3000)]
        texts += [" ".join(words), edited(rng, words, 230)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").cache()
    assert docs.count() == len(texts)
    _, since = shuffled(spark)
    got = {r["order"]: r["component"] for r in S.similar_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == text_groups(texts)
    assert shuffled(spark, since)[0] < 1.5 * sum(map(len, texts))


def test_meetings_are_the_pairs_that_can_be_links():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 400):
        token, root, size, at = rng.integers(0, 12, n), rng.integers(0, 6, n), rng.integers(5, 40, n), rng.integers(0, 5, n)
        num = np.arange(n) * 3
        got = {(int(u), int(v)) for us, vs in S.meetings(token.astype(np.uint64), num, root, size, at, 0.8) for u, v in zip(us, vs)}
        fits = lambda i, j: min(size[i] - at[i], size[j] - at[j]) >= 0.8 / 1.8 * (size[i] + size[j]) - 1e-6 and 0.8 * max(size[i], size[j]) <= min(size[i], size[j]) + 1e-6
        assert got == {(3 * i, 3 * j) for i in range(n) for j in range(i) if token[i] == token[j] and root[i] != root[j] and fits(i, j)}


def test_blocks_and_parities():
    import numpy as np

    rng = np.random.default_rng(7)
    tokens = rng.integers(0, 1 << 40, 99).astype(np.uint64)
    assert (S.unpacked(S.packed(tokens)) == tokens).all()
    a, b = rng.integers(0, 1 << 32, 50), rng.integers(0, 300, 50)
    assert [x.tolist() for x in S.from_planes(S.planes(a, b), 2)] == [a.tolist(), b.tolist()]
    for m, n, both in ((0, 0, 0), (1, 40, 1), (300, 310, 280), (900, 1100, 900), (70, 3000, 12)):
        x = rng.integers(0, 1 << 63, m + n - both).astype(np.uint64)
        least = S.least_difference(S.parities(x[:m]), S.parities(x[m - both :]))
        assert least <= m + n - 2 * both and (least == 0) == (m + n == 2 * both)


def test_recall_of_similar_texts(spark):
    """Recall of the pairs of different texts with a similarity of 0.8 or more, on all documents of the table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    ids = [r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").collect()]
    got = {r["order"]: r["component"] for r in S.similar_groups(docs).collect()}
    want = text_groups(texts)
    pairs = [(i, j) for i, w in enumerate(want) for j in range(i) if want[j] == w]
    assert sum(got[ids[i]] == got[ids[j]] for i, j in pairs) >= 0.9 * len(pairs)
    same = {}
    for i, w in enumerate(want):
        same.setdefault(got[ids[i]], set()).add(w)
    assert all(len(s) == 1 for s in same.values())


def test_similar_groups_of_an_empty_table(spark):
    assert S.similar_groups(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_fingerprint_of_one_shingle_is_the_hash_spark_has(spark):
    texts = ["Alpha beta GAMMA", "one two", "ÀB c  d", "x"]
    want = spark.createDataFrame([(" ".join(x.lower().replace("àb", "Àb") for x in t.split()),) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [signed(S.fingerprint(t)) for t in texts] == [r[0] for r in want]


def test_majority_is_strict_and_repeats_count():
    import xxhash

    words = "a b c d a b c".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2.5)
    assert S.fingerprint(" ".join(words)) == want
    two = [xxhash.xxh64_intdigest(x, 42) for x in ("p q r", "q r s")]
    assert S.fingerprint("p q r s") == two[0] & two[1]


@pytest.mark.parametrize("text", [None, "", " \t\n"])
def test_no_words(text):
    assert S.fingerprint(text) == 0


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "", 2), (5, " ", 3), (5, " ", 3), (9, "a b c", 4)], "doc_id long, text string, component long")
    prints = S.fingerprints(df).cache()
    got = sorted((str(r["doc_id"]), r["component"]) for r in S.near_groups(prints).collect())
    assert got == [("5", 5), ("5", 5), ("9", 9), ("None", 5), ("None", 5)]
    assert S.near_groups(S.fingerprints(df.limit(0)).cache()).count() == 0
