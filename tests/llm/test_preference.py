import random

from latticeflow.llm import preference as P


def render(turns):
    out, spans = "", []
    for role, text in turns:
        a = len(out) + len(f"<|turn|>{role}\n")
        out += f"<|turn|>{role}\n{text}<|end|>"
        if role == "assistant":
            spans.append((a, len(out)))
    return out, spans


def test_equals_brute_force(spark):
    rng = random.Random(6)
    turn = lambda: (rng.choice(["user", "assistant", "system"]), rng.choice(["", "héllo", "a\nb", "x", "日本"]))
    pairs = [(0, [], []), (1, [("user", "x")], []), (2, [("user", "x")], [("user", "x")])]
    for i in range(3, 60):
        shared = [turn() for _ in range(rng.randint(0, 4))]
        pairs.append((i, shared + [turn() for _ in range(rng.randint(0, 3))], shared + [turn() for _ in range(rng.randint(0, 3))]))
    side = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(pairs, f"pair_id long, chosen {side}, rejected {side}")
    got = {r["pair_id"]: r for r in P.preference_pairs(df).collect()}
    for i, a, b in pairs:
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        r = got[i]
        assert (r["prompt_turns"], r["prompt"]) == (n, render(a[:n])[0])
        assert (r["chosen"], [tuple(s) for s in r["chosen_spans"]]) == render(a[n:])
        assert (r["rejected"], [tuple(s) for s in r["rejected_spans"]]) == render(b[n:])


def test_null_sides_and_empty(spark):
    side = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(None, None, [("assistant", "x")])], f"pair_id long, chosen {side}, rejected {side}")
    r = P.preference_pairs(df).first()
    assert (r["prompt"], r["chosen"], r["rejected"]) == ("", "", "<|turn|>assistant\nx<|end|>")
    assert P.preference_pairs(df.limit(0)).count() == 0


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "z"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, 0, "assistant", "r")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn int, role string, text string, turns int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in P.conversations(df).collect()}
    assert got == {1: [("", "z"), ("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], 2: [("assistant", "r")]}
    pair = P.swapped_replies(P.conversations(df)).first()
    assert pair["pair_id"] == 1 and pair["chosen"][:-1] == pair["rejected"][:-1] and pair["rejected"][-1]["text"] == "r"


def test_no_python_in_the_plan(spark, sf_dir):
    from latticeflow.llm import queries

    plan = queries.preferences(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
