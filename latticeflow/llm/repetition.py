"""Quality rules on repetition inside a text, from a suffix array over its words.

Suffixes of all texts of a block are sorted together by prefix doubling; a word's rank depends on its text, so suffixes of
different texts never compare equal. Neighbours' longest common prefixes come from the ranks of all doubling steps. Each
interval of common prefixes is a maximal repeated substring; the union of the spans of those of ``LEAST_WORDS`` words or more
gives the covered share, the longest interval value gives the longest repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words a repeat needs to count as covering; share of words that repeats may cover; words of the longest repeat allowed.
#: The share is the largest one tried at which the labelled documents rejected beyond the base rules are of bad quality twice as often
#: as the others; 50 words is a passage.
LEAST_WORDS, MOST_COVERED, LONGEST_REPEAT = 8, 0.25, 50
#: Words sorted at once in a worker (a longer text is sorted alone).
BLOCK_WORDS = 400_000
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass
class SuffixArray:
    """Suffixes in order, and each one's common prefix in words with the one before it (0 across texts)."""

    suffixes: np.ndarray
    lcp: np.ndarray


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorting order, where a new value begins in it, and the position of each one's group in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)
    return order, new, first


def suffix_array(words: np.ndarray, texts: np.ndarray) -> SuffixArray:
    """``words``: numbers of words, texts one after the other; ``texts``: the text that each word is in, from 0 upwards."""
    n = len(words)
    if n == 0:
        return SuffixArray(np.zeros(0, int), np.zeros(0, int))
    order, new, first = dense(texts.astype(np.int64) * (int(words.max()) + 1) + words)
    rank = np.empty(n, np.int64)
    rank[order] = first
    steps = [rank]
    alone = new & np.concatenate([new[1:], [True]])
    active = order[~alone]
    width = 1
    while len(active):
        after = active + width
        inside = after < n
        inside[inside] = texts[after[inside]] == texts[active[inside]]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[after[inside]] + 1
        by, new, first = dense(rank[active] * (n + 1) + second)
        active = active[by]
        old = rank[active]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        base = np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        fresh = rank.copy()
        fresh[active] = old + first - base
        rank = fresh
        steps.append(rank)
        width *= 2
        active = active[~(new & np.concatenate([new[1:], [True]]))]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    live = np.flatnonzero(steps[0][left] == steps[0][right])
    for k in range(len(steps) - 1, -1, -1):
        a, b = left[live] + common[live], right[live] + common[live]
        ok = (a < n) & (b < n)
        ok[ok] = steps[k][a[ok]] == steps[k][b[ok]]
        common[live[ok]] += 1 << k
    return SuffixArray(suffixes, np.concatenate([[0], common]))


def repeats(array: SuffixArray, texts: np.ndarray, count: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` texts: words covered by repeats of ``least`` words or more, and the longest repeat's words."""
    n = len(array.suffixes)
    reach = np.zeros(n, np.int64)
    if n:
        reach[array.suffixes] = np.maximum(array.lcp, np.concatenate([array.lcp[1:], [0]]))
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, texts, reach)
    at = np.flatnonzero(reach >= least)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + reach[at], minlength=n + 1)
    return np.bincount(texts[np.cumsum(edge)[:n] > 0], minlength=count), longest


def measure(texts: list[str | None], least: int = LEAST_WORDS) -> dict[str, np.ndarray]:
    """The base counts and the repeats of some texts."""
    number: dict[bytes, int] = {}
    ids, sizes, rows = [], [], []
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        bare = len(raw) - len(raw.translate(None, SPACES))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rows.append((len(words), len(t or "") - bare, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
        ids.extend([number.setdefault(w, len(number)) for w in words])
        sizes.append(len(words))
    count = len(texts)
    words, text = np.array(ids, np.int64), np.repeat(np.arange(count), sizes)
    array = suffix_array(words, text)
    covered, longest = repeats(array, text, count, least)
    three, _ = repeats(SuffixArray(array.suffixes, np.where(array.lcp >= 3, 3, 0)), text, count, 3)
    base = np.array(rows, np.int64).reshape(count, 4)
    return {"n_words": base[:, 0], "word_chars": base[:, 1], "n_symbols": base[:, 2], "n_dup_lines": base[:, 3], "n_repeat_words": three, "covered_words": covered, "longest_repeat": longest}


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition(docs: DataFrame, text: str = "text", keep: list[Column] | None = None, least: int = LEAST_WORDS, most_covered: float = MOST_COVERED, longest: int = LONGEST_REPEAT) -> DataFrame:
    """Per row: ``keep``, the base counts, ``covered_words``, ``longest_repeat``, ``base_failed`` and ``kept``.

    Words are runs of anything but ASCII white space. A null or empty text has no words and fails the base rules. Repeated rows
    are judged each on their own; whole texts of any length are read; an empty table gives an empty one. Other columns are not read,
    so their names may clash with the results'; ``keep`` may have none of the results' names.
    """

    def rows(texts: pa.Array) -> pa.Array:
        size, parts, block = 0, [], []
        for t in texts:
            block.append(t.as_py())
            size += len(block[-1] or "") // 5
            if size >= BLOCK_WORDS:
                parts.append(measure(block, least))
                block, size = [], 0
        parts.append(measure(block, least))
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[f] for p in parts])) for f in FIELDS], list(FIELDS))

    small_batches(docs.sparkSession)
    own = keep or [F.col("doc_id")]
    names = docs.select(*own).columns
    measured = docs.select(*own, F.arrow_udf(rows, ", ".join(f"{f} long" for f in FIELDS))(F.col(text)).alias("__measures"))
    out = measured.select(*(F.col(f"`{n}`") for n in names), "__measures.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= F.lit(most_covered) * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
