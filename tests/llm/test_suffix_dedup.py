import hashlib
import random
from collections import Counter

from latticeflow.llm import suffix_dedup as S


def brute(texts):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[i : i + S.DEPTH] for i in range(len(r) - S.DEPTH + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - S.DEPTH + 1):
            if seen[r[i : i + S.DEPTH]] > 1:
                gone[i : i + S.DEPTH] = b"\1" * S.DEPTH
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


def fixture():
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (60, 40, 80)]
    texts = [None, "", "short", "short", "x" * 1000, "ab" * 300, "xyz" * 200, "a" * 199, "b" * 200, "b" * 200, "c" * 201]
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)], prose(rng, rng.randint(0, 30))]
        texts.append(" ".join(parts))
    return texts + texts[-3:] + [texts[-1] + " more"]


def run(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(got, key=lambda r: r["doc_id"])]


def test_equals_brute_force(spark):
    texts = fixture()
    assert run(spark, texts) == brute(texts)


def test_hot_digits_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    monkeypatch.setattr(S, "CHUNK", 700)
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    texts = fixture()
    assert run(spark, texts) == brute(texts)


def test_big_parts_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    monkeypatch.setattr(S, "BIG", 1)
    rng = random.Random(9)
    passage = prose(rng, 70)
    texts = fixture() + [prose(rng, rng.randint(3, 60)) + " " + passage + " " + prose(rng, 40) for _ in range(60)]
    assert run(spark, texts) == brute(texts)


def test_null_keys_repeated_rows_and_clashing_names(spark):
    text = prose(random.Random(1), 100)
    df = spark.createDataFrame([(None, text, 1), (None, text, 2), (3, None, 3)], "doc_id long, text string, n_removed int")
    got = sorted(tuple(r) for r in S.remove_repeats(df).select("n_bytes", "n_removed").collect())
    n = len(text.encode())
    assert got == [(0, 0), (n, n), (n, n)]


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    assert run(spark, texts) == brute(texts)
