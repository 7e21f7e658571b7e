"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree of byte counts, up to ``ORDER`` bytes of context. A byte's probability in its longest
known context is ``count / (total + kinds)``; an unseen byte escapes with ``kinds / (total + kinds)`` to the next shorter context,
with the bytes already ruled out excluded; below order 0 all 256 bytes are equal. The statistics are frozen after learning, so each
byte's exact code length is a fixed number. It is kept for every gram that any language has, for all languages at once; for another
byte, the cost of its context's escape is added to its code length one order below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of context, at most (under 8).
ORDER = 3
#: Documents that a language's statistics are learned from, in expectation.
DOCS_PER_LANGUAGE = 1000
#: Bytes scored at once in a worker.
CHUNK = 1 << 18
UNKNOWN = "und"


@dataclass
class Level:
    """One order of the tree: sorted ``grams`` (context and byte) with ``bits``, sorted ``contexts`` with ``escape``; a column a language."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand in the sorted ``keys``, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class PpmModel:
    """Frozen statistics: levels of orders 0 to ORDER; level 0 has all 256 bytes."""

    languages: list[str]
    levels: list[Level]

    def grams_bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths, a column a language, of the last byte of each gram of ORDER + 1 bytes."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        open_ = np.arange(len(grams))
        for order in range(len(self.levels) - 1, -1, -1):
            level, here = self.levels[order], grams[open_] & np.uint64((1 << (8 * order + 8)) - 1)
            at, ok = found(level.grams, here)
            out[open_[ok]] += level.bits[at[ok]]
            open_, here = open_[~ok], here[~ok]
            if not len(open_):
                break
            at, ok = found(level.contexts, here >> np.uint64(8))
            out[open_[ok]] += level.escape[at[ok]]
        return out

    def code_lengths(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits that each text takes under each language; ``data`` holds the texts' bytes one after the other."""
        out = np.zeros((len(lengths), len(self.languages)))
        full = np.flatnonzero(lengths)
        if not len(full):
            return out
        ends = np.cumsum(lengths[full])
        starts = ends - lengths[full]
        total = np.zeros((len(full), len(self.languages)))
        for at in range(0, len(data), CHUNK):
            lead = min(at, ORDER)
            now = data[at - lead : at + CHUNK].astype(np.uint64)
            n = len(now) - lead
            low, high = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + n, "left")
            grams = now[lead:].copy()
            for back in range(1, ORDER + 1):
                before = np.zeros(n, np.uint64)
                skip = max(0, back - lead)
                before[skip:] = now[lead + skip - back : lead + n - back]
                for i in range(back):  # what stands before a text is byte 0
                    near = starts[low:high] + i
                    near = near[(near < ends[low:high]) & (near >= at) & (near < at + n)] - at
                    before[near] = 0
                grams |= before << np.uint64(8 * back)
            cuts = np.maximum(starts[low:high] - at, 0)
            total[low:high] += np.add.reduceat(self.grams_bits(grams), cuts, axis=0, dtype=np.float64)
        out[full] = total
        return out


def freeze(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> PpmModel:
    """The model of counted byte grams: for each language, grams as integers of ORDER + 1 bytes, and their counts.

    Without any language the model is empty and predicts nothing.
    """
    languages = sorted(grams)
    held = {k: (np.asarray(v[0]).astype(np.uint64), np.asarray(v[1]).astype(np.float64)) for k, v in grams.items()}
    levels, shorter, shorter_p = [], np.zeros(0, np.uint64), np.zeros((0, len(languages)))
    for order in range(ORDER + 1):
        mask = np.uint64((1 << (8 * order + 8)) - 1)
        keys = np.arange(256, dtype=np.uint64) if order == 0 else np.unique(np.concatenate([np.zeros(0, np.uint64), *(k & mask for k, _ in held.values())]))
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        p, escape = np.zeros((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
        below = np.full((len(keys), len(languages)), 1 / 256) if order == 0 else shorter_p[np.searchsorted(shorter, keys & (mask >> np.uint64(8)))]
        for j, language in enumerate(languages):
            own, counts = held[language]
            c = np.bincount(np.searchsorted(keys, own & mask), counts, len(keys))
            total, kinds = np.bincount(of, c, len(contexts)), np.bincount(of, c > 0, len(contexts))
            left = np.where(kinds < 256, 1 - np.bincount(of, np.where(c > 0, below[:, j], 0), len(contexts)), 0)
            out = np.where(left > 0, kinds, 0)  # without an unseen byte nothing escapes
            with np.errstate(invalid="ignore", divide="ignore"):
                factor = np.where(total > 0, out / (total + out) / left, 1.0)
                p[:, j] = np.where(total[of] == 0, below[:, j], np.where(c > 0, c / (total + out)[of], factor[of] * below[:, j]))
                escape[:, j] = -np.log2(np.where(left > 0, factor, 1.0))
        levels.append(Level(keys, -np.log2(p).astype(np.float32) if p.size else p.astype(np.float32), contexts, escape.astype(np.float32)))
        shorter, shorter_p = keys, p
    return PpmModel(languages, levels)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes one after the other, and each row's length; a null has none."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, lengths = _values(batch.column("bytes"))
        ends = np.cumsum(lengths)
        langs = batch.column("lang").to_pylist()
        by: dict[str, list[np.ndarray]] = {}
        for lang, end, n in zip(langs, ends, lengths):
            if n:
                text = np.concatenate([np.zeros(ORDER, np.int64), data[end - n : end]])
                key = np.zeros(n, np.int64)
                for back in range(ORDER, -1, -1):
                    key = (key << 8) | text[ORDER - back : ORDER - back + n]
                by.setdefault(lang, []).append(key)
        for lang, parts in by.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learnable: Column | None = None, docs_per_language: int = DOCS_PER_LANGUAGE) -> PpmModel:
    """Learn the context trees from the rows that ``learnable`` admits and that have a text and a language.

    A language with more than ``docs_per_language`` rows is sampled by a hash of the key, evenly; the counts of grams, not the
    texts, come to the driver. Rows without a text or language teach nothing; repeated rows count as often as they stand there.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(learnable) if learnable is not None else docs
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and t is not null and lang <> 'und'")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return freeze({})
    share = F.pmod(F.xxhash64(F.lit("ppm"), F.col("k")), F.lit(1_000_000))
    wanted = F.lit(False)
    for name, n in sizes.items():
        wanted = wanted | ((F.col("lang") == F.lit(name)) & (share < F.lit(int(min(1.0, docs_per_language / n) * 1_000_000))))
    counted = rows.filter(wanted).select("lang", F.col("t").cast("binary").alias("bytes")).mapInArrow(_count, "lang string, gram long, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    langs = np.array(grams.column("lang").to_pylist(), dtype=object)
    keys, counts = grams.column("gram").to_numpy(), grams.column("n").to_numpy()
    for name in sorted(set(langs)):
        own = langs == name
        out[name] = (keys[own], counts[own])
    return freeze(out)


def predict(docs: DataFrame, model: PpmModel, text: str = "text", key: str = "doc_id", keep: list[Column] | None = None) -> DataFrame:
    """Per row: the key, ``keep``, ``lang_pred``, ``score`` and ``bits_per_byte`` of the predicted language.

    The score is the language's posterior probability at equal priors. A null or empty text, and one without a letter, gets
    ``und`` and score 0; ties go to the first language by name. Whole texts of any length are read; repeated rows are scored alike;
    an empty table gives an empty one; other columns are not read, so their names may clash with the results'.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array, letters: pa.Array) -> pa.Array:
        m, has = held.value, letters.to_numpy(zero_copy_only=False)
        data, lengths = _values(texts)
        bits = m.code_lengths(data, lengths)
        if m.languages:
            best = bits.argmin(1)
            top = bits[np.arange(len(best)), best]
            p = 1 / np.exp2(np.maximum(top[:, None] - bits, -1000)).sum(1)
            names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)]
        else:
            top = p = np.zeros(len(lengths))
            names = [UNKNOWN] * len(lengths)
        columns = [pa.array(names, pa.string()), pa.array(np.where(has, p, 0.0)), pa.array(top / np.maximum(lengths, 1))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "bits_per_byte"])

    small_batches(docs.sparkSession)
    t = F.col(text)
    letters = F.coalesce(t.rlike(r"\p{L}"), F.lit(False))
    scored = F.arrow_udf(score, "lang_pred string, score double, bits_per_byte double")(F.coalesce(t, F.lit("")).cast("binary"), letters)
    kept = docs.select(F.col(key), *(keep or [])).columns
    out = docs.select(F.col(key), *(keep or []), scored.alias("__scored"))
    return out.select(*(F.col(f"`{c}`") for c in kept), "__scored.*")
