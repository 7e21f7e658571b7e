"""Preference formatting: paired conversations to one shared prompt and two completions with loss masks. DataFrame functions only.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the prompt. What follows in
either is a completion; its loss spans are the character ranges of what the assistant says, end mark included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered (parameters): begin mark, role, line feed, text, end mark.
BEGIN, END, LEARNT = "<|turn|>", "<|end|>", "assistant"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, turns)``: each conversation's turns (role, text) in order.

    Null roles and texts count as empty; turns of equal or null number stand in the order of role and text, null numbers first.
    Turns without a key belong to no conversation. A row is one conversation, as its rendering is.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return listed.select(key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def rendered(turns: Column, begin: str = BEGIN, end: str = END) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(begin), t["role"], F.lit("\n"), t["text"], F.lit(end))), "")


def loss_spans(turns: Column, begin: str = BEGIN, end: str = END, learnt: str = LEARNT) -> Column:
    """Array of (start, end): characters of a rendering that the loss counts."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.lit(len(begin)) + F.char_length(t["role"]) + 1
        after = acc["at"] + head + F.char_length(t["text"]) + F.lit(len(end))
        one = F.array(F.struct((acc["at"] + head).alias("start"), after.alias("end")))
        return F.struct(after.alias("at"), F.when(t["role"] == learnt, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame, key: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected", begin: str = BEGIN, end: str = END, learnt: str = LEARNT) -> DataFrame:
    """``pairs`` has arrays of turns (role, text); the result has the key, ``prompt_turns``, ``prompt``, and for either side the
    completion and its spans.

    Equal conversations have empty completions, ones that share nothing an empty prompt; a null side counts as no turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select(F.col(key), F.coalesce(F.col(chosen), none).alias("a"), F.coalesce(F.col(rejected), none).alias("b"))
    both = both.withColumn("prompt_turns", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    both = both.select(key, "prompt_turns", F.slice("a", 1, F.col("prompt_turns")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return both.select(
        key,
        "prompt_turns",
        rendered(F.col("p"), begin, end).alias("prompt"),
        rendered(F.col("a"), begin, end).alias("chosen"),
        loss_spans(F.col("a"), begin, end, learnt).alias("chosen_spans"),
        rendered(F.col("b"), begin, end).alias("rejected"),
        loss_spans(F.col("b"), begin, end, learnt).alias("rejected_spans"),
    )


def swapped_replies(convs: DataFrame, key: str = "conv_id", learnt: str = LEARNT) -> DataFrame:
    """Pairs ``(pair_id, chosen, rejected)`` from plain conversations: the rejected one ends in a reply to something else.

    The chosen conversation runs to its last assistant turn; in the rejected one this turn has the text of the last assistant turn
    of the conversation with the next id. Conversations without a reply, or whose next one has none, form no pair.
    """
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == learnt)), True) + 1
    ended = convs.filter(F.exists("turns", lambda t: t["role"] == learnt)).select(key, F.slice("turns", F.lit(1), last.cast("int")).alias("turns"))
    other = ended.select((F.col(key) - 1).alias(key), F.element_at("turns", -1)["text"].alias("other"))
    swapped = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(F.struct(F.lit(learnt).alias("role"), F.col("other").alias("text"))))
    return ended.join(other, key).select(F.col(key).alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))
