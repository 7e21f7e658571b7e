from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.llm import language_id, quality_fm, queries, toxicity


def arrays(*texts):
    return [np.array(sorted(toxicity.features(toxicity.words_of(t)))) for t in texts]


def test_counterfactual_penalty_closes_the_gap():
    rng = np.random.default_rng(0)
    filler = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = list(rng.choice(filler, 8)) + (["idiot"] if toxic and i % 8 else [])
        if rng.random() < (0.7 if toxic else 0.1):  # mentions go along with the label, but are not its reason
            words.append("women")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    own = arrays(*texts)
    other = []
    for t in texts:
        cf = toxicity.counterfactual(toxicity.words_of(t), toxicity.IDENTITY_TERMS)
        other.append(None if cf is None else np.array(sorted(toxicity.features(cf))))
    keep = frozenset(toxicity.feature(0, w) for g in toxicity.IDENTITY_TERMS for w in g)
    gap = {}
    for penalty in (0.0, 8.0):
        score = toxicity.fit(own, other, np.array(labels), penalty, keep=keep).scorer()
        gap[penalty] = abs(score("w1 w2 women") - score("w1 w2 men"))
        assert score("w1 w2 idiot") > score("w1 w2")
    assert gap[8.0] < 0.5 * gap[0.0]


def test_counterfactual_swaps_within_a_group():
    assert toxicity.counterfactual({"the", "women", "gay"}, toxicity.IDENTITY_TERMS) == {"the", "men", "straight"}
    assert toxicity.counterfactual({"the"}, toxicity.IDENTITY_TERMS) is None


def test_all_swaps_of_a_group_or_all_mentions_of_one():
    groups = (("a", "b", "c"), ("x", "y"))
    whole = lambda w: {toxicity.feature(0, w)}
    assert toxicity.changes({"see", "a"}, groups) == [(sorted(whole("b")), sorted(whole("a"))), (sorted(whole("c")), sorted(whole("a")))]
    mentions = toxicity.changes({"see"}, groups)
    assert mentions in ([(sorted(whole(t)), []) for t in group] for group in groups)
    assert toxicity.changes({"see"}, ()) == []


def test_penalty_against_a_brute_force_descent():
    """The same loss with dense arrays and a numerical gradient at the solution: no direction improves it."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(12)], 5)) + (" idiot" if k % 3 == 0 else "") + (" women" if k % 2 else "") for k in range(60)]
    labels = np.array([k % 3 == 0 for k in range(60)], float)
    words = [toxicity.words_of(t) for t in texts]
    own = [np.array(sorted(toxicity.features(w))) for w in words]
    other = [toxicity.changes(w, toxicity.IDENTITY_TERMS) for w in words]
    keep = frozenset(toxicity.feature(0, w) for g in toxicity.IDENTITY_TERMS for w in g)
    model = toxicity.fit(own, other, labels, 4.0, steps=3000, keep=keep)

    def loss(weights, b):
        z = lambda ids: b + sum(weights.get(int(i), 0.0) for i in ids)
        s = lambda ids: 1 / (1 + np.exp(-z(ids)))
        fit = -np.mean([np.log(s(t) if y else 1 - s(t)) for t, y in zip(own, labels)])
        gaps = [(s(t) - s(set(t.tolist()) - set(gone) | set(new))) ** 2 for t, o in zip(own, other) for new, gone in o]
        return fit + 4.0 * np.mean(gaps) + 0.5e-5 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.intercept)
    for step in (0.05, -0.05):
        assert loss(model.weights, model.intercept + step) > best - 1e-6
        for i in list(model.weights)[:: max(1, len(model.weights) // 12)]:
            assert loss(model.weights | {i: model.weights[i] + step}, model.intercept) > best - 1e-6


def test_the_penalty_acts_on_the_query(spark, sf_dir):
    """On the given tables: weights differ, and neutral mentions change scores less."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learn = lambda penalty: toxicity.learn(docs, labels, queries.remainder(F.col("key"), 4) != 2, penalty=penalty)
    plain, fair = learn(0.0), learn(toxicity.PENALTY)
    assert plain.weights != fair.weights
    texts = [r["text"] for r in docs.limit(200).collect()]
    terms = [t for group in toxicity.IDENTITY_TERMS for t in group]
    moved = {}
    for name, model in (("plain", plain), ("fair", fair)):
        score = model.scorer()
        moved[name] = np.mean([abs(score(f"{t} {term}") - score(t)) for k, t in enumerate(texts) for term in terms[k % 7 :: 7]])
    assert moved["fair"] < moved["plain"]


def test_an_id_repeated_among_labels_and_documents_stays_within_the_bound(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert toxicity.bounded_labelled(docs, labels, "toxic", "text", "doc_id", None, 20).count() == 20


@pytest.mark.parametrize("labels", [[], [1, 1], [0]])
def test_one_class_or_none(labels):
    rows = arrays(*["a b"] * len(labels))
    assert 0 <= toxicity.fit(rows, [None] * len(rows), np.array(labels)).scorer()(None) <= 1
    encode = quality_fm.Encoder()
    assert 0 <= quality_fm.fit([encode("a b")] * len(labels), np.array(labels)).score(*encode(None)) <= 1


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    machine = quality_fm.FactorisationMachine(0.3, rng.normal(size=quality_fm.DIMENSIONS), rng.normal(size=(quality_fm.DIMENSIONS, 5)))
    ids, values = np.array([3, 50, 200, 1000]), rng.normal(size=4)
    pairs = sum(machine.factors[ids[i]] @ machine.factors[ids[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert np.isclose(machine.raw(ids, values), 0.3 + machine.linear[ids] @ values + pairs)


def accuracy(rows, truth, of):
    got = [(r[of], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(a == b for a, b in got) / len(got)


@pytest.mark.parametrize("query, label, least", [(queries.toxicity_scores, "toxic", 0.9), (queries.quality_scores, "quality", 0.93)])
def test_held_out_labels(spark, sf_dir, query, label, least):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, truth, "predicted") >= least


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert accuracy(queries.language_predictions(spark, sf_dir).collect(), truth, "lang_pred") >= 0.97


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark):
    words = ["good fine text", "idiot scum text"]
    rows = [(i, words[i % 2] + f" n{i % 7}") for i in range(200)]
    docs = spark.createDataFrame([(i, t, "xx", "yy") for i, t in rows], "doc_id long, text string, score string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(queries.remainder(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    learn = lambda l: toxicity.learn(docs, l, queries.remainder(F.col("key"), 4) != 2)
    assert learn(labels) == learn(flipped)


def test_null_empty_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "idiot " * 50_000), (2, None), (None, ""), (4, "fine"), (4, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, toxic int, quality int")
    for module, label in ((toxicity, "toxic"), (quality_fm, "quality")):
        out = module.score(docs, module.learn(docs, labels, label=label)).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
        empty = docs.limit(0)
        assert module.score(empty, module.learn(empty, labels.limit(0), label=label)).count() == 0


def ppm(*texts):
    grams = {}
    for lang, text in texts:
        data = np.frombuffer(b"\0" * language_id.ORDER + text.encode(), np.uint8).astype(np.int64)
        n = len(data) - language_id.ORDER
        keys, counts = np.unique(sum(data[language_id.ORDER - b : language_id.ORDER - b + n] << (8 * b) for b in range(language_id.ORDER + 1)), return_counts=True)
        grams[lang] = (keys, counts)
    return language_id.freeze(grams)


class NaivePpm:
    """Counts in dictionaries and the definition word by word: exclusion by going through all 256 bytes."""

    def __init__(self, text):
        self.counts = {}
        padded = b"\0" * language_id.ORDER + text.encode()
        for i in range(language_id.ORDER, len(padded)):
            for k in range(language_id.ORDER + 1):
                seen = self.counts.setdefault(padded[i - k : i], {})
                seen[padded[i]] = seen.get(padded[i], 0) + 1

    @cache
    def p(self, context, byte):
        lower = (lambda x: self.p(context[1:], x)) if context else (lambda x: 1 / 256)
        seen = self.counts.get(context)
        if not seen:
            return lower(byte)
        unseen = [x for x in range(256) if x not in seen]
        total, kinds = sum(seen.values()), len(seen) if unseen else 0
        if byte in seen:
            return seen[byte] / (total + kinds)
        return kinds / (total + kinds) * lower(byte) / sum(map(lower, unseen))


def test_code_lengths_equal_a_naive_tree():
    learnt = {"a": "the cat sat on the mat. the hat", "b": "der Hut läuft über 日本 Straße"}
    model, naive = ppm(*learnt.items()), {k: NaivePpm(t) for k, t in learnt.items()}
    for text in ("the cat", "日本語", "zz\u0001ß the", "der Hut der"):
        raw = text.encode()
        got = model.code_lengths(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0]
        padded = b"\0" * language_id.ORDER + raw
        want = [-sum(np.log2(naive[k].p(padded[i - language_id.ORDER : i], padded[i])) for i in range(language_id.ORDER, len(padded))) for k in "ab"]
        assert np.allclose(got, want, rtol=1e-4)


def test_every_context_spends_exactly_one():
    model = ppm(("a", "the cat sat on the mat. " * 9), ("b", "der Hund läuft über die Straße"))
    for context in (b"the", b"\0\0\0", b"cat", b"\xc3\xa4u", b"xyz", b"zat"):
        grams = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert np.allclose(np.exp2(-model.grams_bits(grams).astype(float)).sum(0), 1, atol=1e-4)


def test_a_long_text_through_spark(spark):
    docs = spark.createDataFrame([(i, "the cat sat " * 5, "en", 1.0) for i in range(20)] + [(90, "der Hund läuft " * 40_000, "de", 2.0), (91, "der Hund", "de", 3.0)], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert got[90] == got[91] == "de" and got[3] == "en"


def test_code_lengths_do_not_depend_on_neighbours(monkeypatch):
    model = ppm(("a", "the cat sat"), ("b", "der Hund"))
    texts = [b"the", b"", b"x", b"catcat cat", b"de", b"der Hund der cat"]
    alone = [model.code_lengths(np.frombuffer(t, np.uint8), np.array([len(t)]))[0] for t in texts]
    for chunk in (1 << 20, 3, 5):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        both = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
        assert np.allclose(both, alone)


def test_undetermined(spark):
    docs = spark.createDataFrame([(i, "the cat sat", "en") for i in range(20)] + [(30, None, "en"), (31, "12 ?!", "de"), (32, "", None), (None, "cat", None)], "doc_id long, text string, lang string")
    rows = language_id.predict(docs, language_id.learn(docs)).collect()
    assert {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (30, 31, 32)} == {"30": ("und", 0.0), "31": ("und", 0.0), "32": ("und", 0.0)}
    assert [r["lang_pred"] for r in rows if r["doc_id"] is None] == ["en"]
    assert language_id.predict(docs, language_id.learn(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
