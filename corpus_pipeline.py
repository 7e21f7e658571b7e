"""A pipeline over ``documents``: STAGES are (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame.

``run`` writes what each stage keeps as Parquet into the shared folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import packing, phrase_index, simhash, suffix_dedup, toxicity
from latticeflow.llm.common import cut, join_checked, remainder, table
from latticeflow.llm.queries import tokenizer_path
from latticeflow.storage import cuts_made, publish


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.3, with all their columns, whatever the names.

    Null and empty texts have the score of no feature; each of repeated rows is judged alike; an empty table stays empty.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), learnable=remainder(F.col("key"), 4) != 2)
    scored = toxicity.score(docs, model, keep=[F.col(c).alias(f"_in_{c}") for c in docs.columns])
    return scored.filter("score < 0.3").select(*(F.col(f"`_in_{c}`").alias(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8: the one with the least doc_id.

    Null ids come last; of repeated ids the first row read stays. Documents without a word, null texts included, are one group.
    An empty table stays empty; columns may have any names.
    """
    numbered = cut(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row")
    first = cuts_made()
    groups = simhash.similar_groups(numbered.select(order.alias("order"), F.col("doc.text").alias("text")), order="order")
    kept = publish(groups.filter("order = component").select(F.col("order.row").alias("row")), "kept", first)
    return join_checked(numbered, kept, ["row"], "left_semi", kept.count()).select("doc.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated byte strings; one of which nothing but white space is left goes.

    A character that a cut splits goes as a whole; ``n_chars`` follows the new text. A null or empty text has no repeats and stays
    as it is; all of repeated rows lose what they repeat; an empty table stays empty; other columns may have any names.
    """
    own = [c for c in docs.columns if c != "text"]
    keep = [*(F.col(c).alias(f"_in_{c}") for c in own), F.col("text").isNull().alias("_in_text is null")]
    cleaned = suffix_dedup.remove_repeats(docs, keep=keep)
    cleaned = cleaned.filter("n_removed = 0 or trim(kept_text) <> ''")
    text = F.when(F.col("`_in_text is null`"), F.lit(None)).otherwise(F.col("kept_text"))
    columns = {c: F.col(f"`_in_{c}`") for c in own} | {"text": text}
    if "n_chars" in own:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.char_length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(columns[c].alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, with all their columns, whatever the names.

    Null and empty texts have no words and stay; each of repeated rows is searched; an empty table stays empty.
    """
    found = phrase_index.search(docs, table(spark, sf_dir, "benchmark"), keep=[F.col(c).alias(f"_in_{c}") for c in docs.columns])
    return found.filter("not contaminated").select(*(F.col(f"`_in_{c}`").alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is one piece that holds the end id alone; each of repeated rows is packed; an empty table gives no piece; of
    the other columns only doc_id is read.
    """
    return packing.pack(docs, packing.Vocabulary.load(tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", pack),
]

#: Scores of a learnt classifier and ids of a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What led up to a stage's output is deleted from the shared folder once the output is written."""
    docs, first = table(spark, sf_dir, "documents"), cuts_made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = publish(docs, name, first)
    return docs
