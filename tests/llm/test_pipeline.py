import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import pytest

import corpus_pipeline as C
from latticeflow.llm import phrase_index, queries

from .test_phrase_index import brute as hits
from .test_simhash import text_groups
from .test_suffix_dedup import brute as left

SMALL = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stage = dict(C.STAGES)
    scores = {r["doc_id"]: r["score"] for r in queries.toxicity_scores(spark, SMALL).collect()}
    now = stage["toxicity"](spark, docs, SMALL).cache()
    assert now.columns == columns
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(k for k, s in scores.items() if s < 0.3)

    rows = sorted(now.collect(), key=lambda r: r["doc_id"])
    component = text_groups([r["text"] for r in rows])
    now = stage["simhash_near_dedup"](spark, now, SMALL).cache()
    assert now.columns == columns
    assert sorted(map(tuple, now.collect())) == sorted(tuple(r) for i, r in enumerate(rows) if component[i] == i)

    rows = sorted(now.collect(), key=lambda r: r["doc_id"])
    want = left([r["text"] for r in rows])
    now = stage["suffix_array_dedup"](spark, now, SMALL).cache()
    assert now.columns == columns
    got = {r["doc_id"]: r for r in now.collect()}
    for r, (n, removed, _, _) in zip(rows, want):
        if removed == 0:
            assert tuple(got[r["doc_id"]]) == tuple(r)
        elif r["doc_id"] in got:
            assert n - removed - 6 * 3 <= len(got[r["doc_id"]]["text"].encode()) <= n - removed
            assert got[r["doc_id"]]["n_chars"] == len(got[r["doc_id"]]["text"])
        else:
            assert n - removed < 20

    rows = sorted(now.collect(), key=lambda r: r["doc_id"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [tuple(r) for r, h in zip(rows, hits([r["text"] for r in rows], items)) if not h[-1]]
    now = stage["benchmark_decontamination"](spark, now, SMALL).cache()
    assert now.columns == columns and sorted(map(tuple, now.collect())) == sorted(clean)

    packed = stage["best_fit_packing"](spark, now, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r[columns.index("doc_id")] for r in clean}
    assert phrase_index.WINDOW == 10


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in key) for r in docs.collect()) == sorted(tuple(r[k] for k in key) for r in C.run(spark, SMALL).collect())


def test_near_copies_keep_one_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9), (7, "x y z w v", "en", "s", 9), (7, "x y z w v", "en", "s", 9), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(C.STAGES)["simhash_near_dedup"](spark, df, SMALL).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "7", "None"]


#: Names that the operators use or return, beside those of the table.
CLASH = "score n_removed n_spans spans bytes kept_text fp node uid term pos kept words component row doc order n_words n_hit near held_out piece start length label".split()
LONG = "alpha beta gamma delta " * 30_000


def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a plain short text"), (4, "a plain short text"), (None, "another one"), (None, None), (7, LONG), (8, "x" * 500)]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *[c if k % 2 else None for k, c in enumerate(CLASH)]) for i, t in rows], schema)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_take_nulls_repeats_long_texts_empty_tables_and_any_names(spark, name):
    stage, df = dict(C.STAGES)[name], odd(spark)
    out = stage(spark, df, SMALL)
    rows = out.collect()
    none = stage(spark, df.limit(0), SMALL)
    assert none.count() == 0 and none.columns == out.columns
    if name == "best_fit_packing":
        whole = {}
        for r in rows:
            whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
        assert whole[1] == 1 and whole[2] == 1 and whole[None] >= 3 and whole[7] > 10_000 and whole[4] == 2 * len({4}) * (whole[4] // 2)
        return
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    got = sorted((str(r["doc_id"]), str(r["text"])[:20]) for r in rows)
    every = sorted((str(r["doc_id"]), str(r["text"])[:20]) for r in df.collect())
    if name == "simhash_near_dedup":  # those without a word are one group, the repeated rows another
        assert [k for k, _ in got] == sorted(["1", "4", "7", "8", "None"])
    elif name == "suffix_array_dedup":
        assert [k for k, _ in got] == sorted(["1", "2", "3", "4", "4", "7", "None", "None"]) or [k for k, _ in got] == sorted(["1", "2", "3", "4", "4", "None", "None"])
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    elif name == "benchmark_decontamination":
        assert got == every
    for r in rows:  # the other columns come through as they are
        assert [r[c] for c in CLASH] == [c if k % 2 else None for k, c in enumerate(CLASH)]
