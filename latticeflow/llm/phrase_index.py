"""Distributed positional inverted index over documents, with exact phrase and proximity search. DataFrame functions only.

A posting is (term, document, position). One pass over the texts stores the postings of all terms of the test set, sorted by term within
each part. A phrase is searched from its rarest terms: the postings of the rarest one, less its offset in the phrase, are the places
where the phrase may start; they are intersected with the postings of the second rarest, less its own offset, and what is left with
those of all others. Proximity is the same with a range of positions instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_checked

#: Words of a window; words to either side of a window's rarest term within which its other terms count as near.
WINDOW, WITHIN = 10, 15
#: Numbers of documents, of eight bytes, that are broadcast; beyond, the postings are shuffled to them.
FEW_DOCUMENTS = 2_000_000
#: Stands for the end of a document among its terms; no word has this character.
END = "\0"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: the ASCII characters that are neither letters nor digits.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def windows(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``(item, i, words)``: every window of ``width`` consecutive words, or the whole of a shorter item; none of an empty one."""
    split = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = F.explode(F.expr(f"sequence(0, greatest(size(w) - {width}, 0))")).alias("i")
    return split.select("item", "w", starts).select("item", "i", F.expr(f"slice(w, i + 1, {width})").alias("words"))


def stored(docs: DataFrame, terms: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The index: ``(term, uid, pos, kept)`` for each occurrence of the ``terms`` (term, one row each), sorted by term in each part.

    Each document has one more posting, of the term END at the position after its last word, which alone carries its ``keep`` columns.
    """
    kept = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.lit(1).alias("there"))
    given = docs.select(F.monotonically_increasing_id().alias("uid"), words(F.col(text)).alias("w"), kept.alias("kept"))
    none = F.when(F.lit(False), F.col("kept"))
    place = lambda w, i: F.struct(w.alias("term"), i.alias("pos"), none.alias("kept"))
    last = F.struct(F.lit(END).alias("term"), F.size("w").alias("pos"), F.col("kept").alias("kept"))
    each = given.select("uid", F.explode(F.concat(F.transform("w", place), F.array(last))).alias("p")).select("uid", "p.*")
    known = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(END,)], "term string"))
    return cut(join_checked(each, known, ["term"], "left_semi", terms.count() + 1).sortWithinPartitions("term", "uid", "pos"), "postings")


def ordered_phrases(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``(phrase, item, size, terms)``: the different windows' terms as (n, off, term), rarest first, ties by offset.

    A phrase with a term that no document has cannot occur and is left out.
    """
    ids = cut(phrases.select("item", "words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    each = ids.select("phrase", F.posexplode("words").alias("off", "term")).join(counts, "term")
    listed = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("terms"))
    return ids.join(listed, "phrase").filter("size(terms) = size(words)").select("phrase", "item", F.size("words").alias("size"), "terms")


def starts(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(phrase, uid, at)``: where the rarest term of a phrase stands."""
    first = phrases.select("phrase", F.col("terms")[0]["term"].alias("term"))
    found = join_checked(index.select("term", "uid", "pos"), first, ["term"], "inner", first.count())
    return found.select("phrase", "uid", F.col("pos").alias("at"))


def intersected(index: DataFrame, phrases: DataFrame, at: DataFrame, within: int | None = None) -> DataFrame:
    """Of the places ``at`` of the rarest terms, those at which all other terms stand too: at their offsets from it, or, with ``within``,
    anywhere that many words away at most.

    The second rarest terms come first: their postings are few. What all others are intersected with are the postings of the documents
    that are left, which are told by a broadcast of their numbers, up to FEW_DOCUMENTS.
    """

    def met(places: DataFrame, terms: DataFrame, wanted: DataFrame) -> DataFrame:
        # One row for each place and term that is there.
        need = join_checked(places, wanted, ["phrase"], "inner", wanted.count()).select("phrase", "uid", "at", "term", (F.col("at") + F.col("gap")).alias("pos"))
        if within is None:
            return terms.join(need.hint("shuffle_hash"), ["term", "uid", "pos"])
        there = terms.join(need.drop("pos").distinct().hint("shuffle_hash"), ["term", "uid"])
        return there.filter(F.abs(F.col("pos") - F.col("at")) <= within).select("phrase", "uid", "at", "term").distinct()

    postings_ = index.select("term", "uid", "pos")
    second = phrases.filter("size > 1").select("phrase", F.col("terms")[1]["term"].alias("term"), (F.col("terms")[1]["off"] - F.col("terms")[0]["off"]).alias("gap"))
    alone = join_checked(at, phrases.filter("size = 1").select("phrase"), ["phrase"], "left_semi", 1)
    rare = second.select("term").distinct()
    of_second = join_checked(postings_, rare, ["term"], "left_semi", rare.count())
    left = cut(met(at, of_second, second).select("phrase", "uid", "at").unionByName(alone).distinct(), "left")
    others = phrases.select("phrase", F.col("terms")[0]["off"].alias("first"), F.explode(F.slice("terms", 3, 1 << 20)).alias("t"))
    others = cut(others.select("phrase", F.col("t.term").alias("term"), (F.col("t.off") - F.col("first")).alias("gap")), "others")
    documents = cut(left.select("uid").distinct(), "documents")
    there = met(left, join_checked(postings_, documents, ["uid"], "left_semi", documents.count(), FEW_DOCUMENTS), others)
    number = F.count_distinct("term") if within is not None else F.count(F.lit(1))
    have = there.groupBy("phrase", "uid", "at").agg(number.alias("have"))
    want = others.groupBy("phrase").agg((F.count_distinct("term") if within is not None else F.count(F.lit(1))).alias("want"))
    whole = left.join(want, "phrase", "left").join(have, ["phrase", "uid", "at"], "left")
    return whole.filter(F.coalesce("want", F.lit(0)) == F.coalesce("have", F.lit(0))).select("phrase", "uid", "at")


def search(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW, within: int = WITHIN, keep: list[Column] | None = None) -> DataFrame:
    """Per document: ``keep``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``n_near``.

    A word is hit if it lies in an occurrence of any window of any item; ``n_near`` is the number of items with a window of which all
    terms stand at most ``within`` words from an occurrence of its rarest term, in any order. Null and empty texts have no words;
    whole texts of any length are read. An item with a null id hits words but is not listed; items that share an id count once.
    Repeated documents are searched each on their own; an empty table of either kind finds nothing. Other columns are not read.
    """
    own = keep or [F.col("doc_id")]
    names = docs.select(*own).columns
    phrases = windows(items, item_key, item_text, width)
    terms = cut(phrases.select(F.explode("words").alias("term")).distinct(), "terms")
    given = docs.select(*(c.alias(f"__keep{i}") for i, c in enumerate(own)), F.col(text).alias("__text"))
    index = stored(given, terms, "__text", [f"__keep{i}" for i in range(len(own))])
    counts = cut(index.filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    asked = cut(ordered_phrases(phrases, counts), "asked")
    size = asked.count()
    at = cut(starts(index, asked), "starts")

    exact = join_checked(intersected(index, asked, at), asked.select("phrase", "item", "size", F.col("terms")[0]["off"].alias("off")), ["phrase"], "inner", size)
    exact = exact.withColumn("start", F.col("at") - F.col("off"))
    near = join_checked(intersected(index, asked, at, within).select("phrase", "uid").distinct(), asked.select("phrase", "item"), ["phrase"], "inner", size)
    by = cut(exact.groupBy("uid").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("item").alias("items")), "hits")
    close = cut(near.groupBy("uid").agg(F.count_distinct("item").alias("n_near")), "near")
    ends = index.filter(F.col("term") == END).select("uid", F.col("pos").alias("n_words"), "kept")
    out = join_checked(join_checked(ends, by, ["uid"], "left", by.count()), close, ["uid"], "left", close.count())
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.size - 1)))))")
    listed = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return out.select(
        *(F.col(f"kept.c{i}").alias(n) for i, n in enumerate(names)),
        F.col("n_words").cast("long").alias("n_words"),
        F.when(F.col("spans").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
