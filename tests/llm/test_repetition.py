import random

from latticeflow.llm import repetition as R


def brute(text, least):
    w = (text or "").encode().split()
    n = len(w)
    lcp = lambda i, j: next((k for k in range(n - j) if w[i + k] != w[j + k]), n - j)
    covered, longest = set(), 0
    for j in range(n):
        for i in range(j):
            k = lcp(i, j)
            longest = max(longest, k)
            if k >= least:
                covered |= set(range(i, i + k)) | set(range(j, j + k))
    seen = {}
    for i in range(n - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    three = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text or "")
    return n, chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(three), len(covered), longest


def fixture():
    rng = random.Random(4)
    text = lambda n, k: " ".join(rng.choice([f"w{i}" for i in range(k)] + ["é#"]) for _ in range(n))
    texts = [None, "", " \t", "a", "a a a a a a a a a a a a", "x y " * 40, " nbsp stays one", "l1\nl1\n\n \nl2\r\nl1", text(60, 1000)]
    texts += [text(rng.randint(1, 70), rng.choice([2, 3, 8, 40])) for _ in range(40)]
    p = text(30, 500)
    return texts + [f"{p} {text(20, 500)} {p}\n{p}"]


def test_measures_equal_brute_force():
    texts = fixture()
    got = R.measure(texts)
    assert [tuple(int(got[f][i]) for f in R.FIELDS) for i in range(len(texts))] == [brute(t, R.LEAST_WORDS) for t in texts]


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_WORDS", 50)
    texts = fixture()
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = sorted(R.repetition(df).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[f] for f in R.FIELDS) for r in rows] == [brute(t, R.LEAST_WORDS) for t in texts]
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["covered_words"] <= R.MOST_COVERED * r["n_words"] and r["longest_repeat"] <= R.LONGEST_REPEAT)


def test_limits_reject(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(f"u{rng.random()}" for _ in range(n))
    p, q = text(25), text(51)
    pasted = text(190)
    rows = [(1, text(60)), (2, f"{p} {text(40)} {p}"), (3, f"{q} {text(900)} {q}"), (4, f"{text(100)} {p} {text(100)} {p}"), (5, " ".join(f"{text(310)} {pasted}" for _ in range(4))), (6, f"{text(100)} {p} {text(180)} {p} {p}")]
    got = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in R.repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (True, False), 5: (False, False), 6: (True, False)}
    strict = {r["doc_id"]: r["kept"] for r in R.repetition(spark.createDataFrame(rows, "doc_id long, text string"), most_covered=0.1, longest=20).collect()}
    assert strict == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_empty_table(spark):
    assert R.repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0
