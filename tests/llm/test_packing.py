import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from latticeflow.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load(str(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


TEXTS = ["", None, "Hello  world\n\n\t x's don't 123abc ÀÉ 日本 ✨", "a<|endoftext|>b <|endoftext|>", "   ", "  x", "  y\r\n", "word " * 3000, "=" * 3000, "a" * 1023]


def test_ids_equal_the_tokenizers_library(vocabulary, reference):
    encode = vocabulary.encoder()
    for t in TEXTS:
        assert encode(t or "").tolist() == [*reference.encode(t or "", add_special_tokens=False).ids, 2]


def test_pieces_round_trip_and_fill_sequences(spark, vocabulary, reference):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "Gamma", "naïve", "42", "\n"]) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    df = spark.createDataFrame([(i if i != 3 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(5)
    rows = P.pack(df, vocabulary).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i if i != 3 else None], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc32(ids[at : at + r["length"]].tobytes())
            assert r["piece"] == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids) and len(own) == -(-len(ids) // 1024)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_each_piece_once_and_wastes_little(seed):
    rng = random.Random(seed)
    lengths = [min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000)]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    plan = P.plan(dict(histogram))
    used = np.zeros(plan.sequences, int)
    for length, n in histogram.items():
        runs = sorted(zip(plan.first[length], plan.sequence[length], plan.offset[length]))
        ends = [a for a, _, _ in runs[1:]] + [n]
        assert runs[0][0] == 0
        for (a, s, _), b in zip(runs, ends):
            np.add.at(used, np.arange(s, s + b - a), length)
    assert used.max() <= 1024 and used.min() > 0
    assert plan.sequences <= 1.01 * sum(lengths) / 1024 + 2


def test_nothing_to_pack(spark, vocabulary):
    assert P.plan({}).sequences == 0
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_other_merge_order_is_refused(tmp_path):
    import json

    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}}))
    with pytest.raises(ValueError):
        P.Vocabulary.load(str(path))
