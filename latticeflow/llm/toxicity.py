"""Toxicity: a counterfactually regularised linear classifier.

Logistic regression over hashed words and word beginnings. Each learnt sentence has counterfactuals: where it names an identity group,
the terms are swapped for every other one of their group; where it names none, each term of one group is put into it. The loss adds
the squared changes of the score, so that a mere mention moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim

#: Groups of terms that may stand for each other, in English, German, French and Spanish (a parameter: pass other lists).
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("schwarze", "weiße", "araber", "asiaten"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("schwule", "lesben", "bisexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("noirs", "blancs", "arabes", "asiatiques"),
    ("immigrés", "réfugiés", "étrangers"),
    ("homosexuels", "lesbiennes", "bisexuels"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("negros", "blancos", "árabes", "asiáticos"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("homosexuales", "lesbianas", "bisexuales"),
)
#: Labelled documents that the classifier learns from, at most; the ones with the smallest hash of the key are taken.
LEARN_ROWS = 8000
#: Parts in which they are turned into features.
LEARN_PARTS = 16
#: Hash space of the features, lengths of word beginnings, weight of the counterfactual penalty.
SPACE, BEGINNINGS, PENALTY = 1 << 20, (3, 4, 5), 4.0
#: A feature is kept if it is in so many learnt texts, and its rates in the two classes differ by so many deviations and times.
LEAST_TEXTS, LEAST_Z, LEAST_RATIO = 4, 3.5, 3.0

#: Words whose features a worker remembers.
KNOWN_WORDS = 100_000

WORD = re.compile(r"[^\W\d_]+")


def feature(kind: int, part: str) -> int:
    return crc32(f"{kind}:{part}".encode()) % SPACE


def features(words: set[str]) -> set[int]:
    """Hashed words and beginnings; kind 0 is a whole word, kind n a beginning of n letters."""
    out = {feature(0, w) for w in words}
    for n in BEGINNINGS:
        out |= {feature(n, b) for b in {w[:n] for w in words if len(w) >= n}}
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counterfactual(words: set[str], groups: tuple[tuple[str, ...], ...], by: int = 1) -> set[str] | None:
    """The words with each identity term replaced by the one ``by`` places on in its group; None if there is no such term."""
    swap = {term: group[(i + by) % len(group)] for group in groups for i, term in enumerate(group)}
    found = words & swap.keys()
    return (words - found) | {swap[w] for w in found} if found else None


def changes(words: set[str], groups: tuple[tuple[str, ...], ...]) -> list[tuple[list[int], list[int]]]:
    """(features added, features removed) by each counterfactual of a text: all swaps, or without a term all mentions of one group."""
    if not groups:
        return []
    swaps = [counterfactual(words, groups, by) for by in range(1, max(map(len, groups)))]
    others = [x for x in swaps if x is not None and x != words]
    if not others and swaps[0] is None:
        group = groups[crc32(" ".join(sorted(words)).encode("utf-8", "replace")) % len(groups)]
        others = [words | {term} for term in group]
    gone_or_new = [(o - words, words - o) for o in others]
    own = features(words) if others else set()
    out = []
    for (new, gone), other in zip(gone_or_new, others):
        left = features(other) if gone else own | features(new)
        out.append((sorted(left - own), sorted(own - left)))
    return out


@dataclass
class ToxicityModel:
    """Weights of the kept features, by hash, and the intercept."""

    weights: dict[int, float]
    intercept: float

    def scorer(self):
        """A function from a text to its score; words seen before are not hashed again."""
        weights, intercept = self.weights, self.intercept
        known: list[dict[str, list[int]]] = [{}]

        def hits(word: str) -> list[int]:
            ids = [feature(0, word), *(feature(n, word[:n]) for n in BEGINNINGS if len(word) >= n)]
            out = [i for i in ids if i in weights]
            if len(known[0]) > KNOWN_WORDS:
                known[0] = {}
            known[0][word] = out
            return out

        def score(text: str | None) -> float:
            memo, ids = known[0].get, set()
            for w in words_of(text):
                h = memo(w)
                if h is None:
                    h = hits(w)
                if h:
                    ids.update(h)
            z = intercept + sum(weights[i] for i in sorted(ids))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def fit(texts: list[np.ndarray], swapped: list, labels: np.ndarray, penalty: float = PENALTY, steps: int = 400, keep: frozenset[int] = frozenset()) -> ToxicityModel:
    """Learn from feature arrays, their counterfactuals and 0/1 labels. ``keep``: features kept whatever their rates.

    ``swapped`` has for each text the features of a counterfactual, or a list of (added, removed) features, or None. With no row, or
    one class only, the model is the intercept of the smoothed rate.
    """
    y = np.asarray(labels, float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel({}, intercept)
    flat = np.concatenate([np.zeros(0, np.int32), *texts]).astype(np.int32, copy=False)
    ends = np.cumsum([len(t) for t in texts])
    pos, both = np.zeros(SPACE), np.zeros(SPACE)
    for at in range(0, len(flat), SPACE):
        part = flat[at : at + SPACE]
        bad = y[np.searchsorted(ends, np.arange(at, at + len(part)), "right")] > 0
        pos += np.bincount(part[bad], minlength=SPACE)
        both += np.bincount(part, minlength=SPACE)
    neg = both - pos
    n1, n0 = y.sum(), len(y) - y.sum()
    p1, p0, p = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1), (pos + neg + 1) / (len(y) + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    good = (pos + neg >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z) & (np.maximum(p1 / p0, p0 / p1) >= LEAST_RATIO)
    good[list(keep)] = True
    kept = np.flatnonzero(good)
    place = np.full(SPACE, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the kept features; one array for all rows, as thousands of small ones would stay with the driver."""
        cols = place[np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32, copy=False)]
        there = np.flatnonzero(cols >= 0)
        return np.searchsorted(np.cumsum([len(r) for r in rows]), there, "right"), cols[there]

    row, col = matrix(texts)
    pairs = [(i, np.asarray(new, np.int32), np.asarray(gone, np.int32)) for i, s in enumerate(swapped) if s is not None for new, gone in (s if isinstance(s, list) else [(np.setdiff1d(s, texts[i]), np.setdiff1d(texts[i], s))])]
    paired = np.array([i for i, _, _ in pairs], int)
    nrow, ncol = matrix([new for _, new, _ in pairs])
    grow, gcol = matrix([gone for _, _, gone in pairs])
    crow, ccol, sign = np.concatenate([nrow, grow]), np.concatenate([ncol, gcol]), np.concatenate([np.ones(len(nrow)), -np.ones(len(grow))])
    w, b = np.zeros(len(kept)), intercept
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(y)) + b
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        err = (s - y) / len(y)
        own = np.zeros(len(kept))
        if len(paired):
            c = 1 / (1 + np.exp(-np.clip(z[paired] + np.bincount(crow, sign * w[ccol], len(paired)), -40, 40)))
            gap = 2 * penalty * (s[paired] - c) / len(paired)
            cerr = -gap * c * (1 - c)
            err += np.bincount(paired, gap * s[paired] * (1 - s[paired]) + cerr, len(y))
            own = np.bincount(ccol, sign * cerr[crow], len(kept))
        grad = np.append(np.bincount(col, err[row], len(kept)) + own + 1e-5 * w, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return ToxicityModel(dict(zip(kept.tolist(), w.tolist())), float(b))


def _learnt(groups: tuple[tuple[str, ...], ...]):
    ids = pa.list_(pa.int32())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column("text")]
            own = [np.fromiter(sorted(features(w)), np.int32) for w in words]
            other = [[x for new, gone in changes(w, groups) for x in (len(new), *new, len(gone), *gone)] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(own, ids), pa.array(other, ids)], ["place", "label", "own", "changes"])

    return rows


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A list column's rows as views of one array."""
    out = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends, ends[1:])]
    return out


def in_order(got: pa.Table, *lists: str) -> tuple:
    """The list columns' rows, as views, and the labels, in the order of ``place``."""
    order = np.argsort(got.column("place").to_numpy(), kind="stable")
    columns = (arrays(got.column(c)) for c in lists)
    return *([c[i] for i in order] for c in columns), got.column("label").to_numpy()[order]


def _pairs(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(added, removed) of each counterfactual from their lengths and features one after the other."""
    parts, at = [], 0
    while at < len(flat):
        n = int(flat[at])
        parts.append(flat[at + 1 : at + 1 + n])
        at += n + 1
    return list(zip(parts[::2], parts[1::2]))


def bounded_labelled(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, learnable: Column | None, rows: int) -> DataFrame:
    """(place, text, label) of ``rows`` labelled documents at most, those with the smallest hash of the key; ``place`` is their order.

    The bound holds however often an id is repeated, among labels or documents. The rows are dealt out again after the limit.
    """
    chosen = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label is not null")
    if learnable is not None:
        chosen = chosen.filter(learnable)
    chosen = chosen.orderBy(F.xxhash64(F.lit(label), "key"), "key", "label").limit(rows)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    first = found.orderBy(F.xxhash64("key"), "key", F.xxhash64("text"), "label").limit(rows)
    return first.select(F.monotonically_increasing_id().alias("place"), "text", "label").repartition(LEARN_PARTS)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = LEARN_ROWS, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = PENALTY) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents; ``learnable`` is a condition on the column ``key``.

    A null text counts as empty; rows without a key or label teach nothing; repeated rows count as often as they stand there; other
    columns are not read; without rows the model knows the smoothed rate only.
    """
    small_batches(docs.sparkSession)
    sample = bounded_labelled(docs, labels, label, text, key, learnable, rows)
    got = sample.mapInArrow(_learnt(groups), "place long, label int, own array<int>, changes array<int>").toArrow()
    identity = frozenset(feature(0, w) for group in groups for w in group)
    own, other, labels_ = in_order(got, "own", "changes")
    model = fit(own, [_pairs(x) for x in other], labels_, penalty, keep=identity)
    del got, own, other
    trim()
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Columns ``keep`` and ``score`` for every row; a null or empty text gets the score of no feature.

    Whole texts of any length are read; repeated rows are scored alike; an empty table gives an empty one. Other columns are not
    read; ``keep`` may have no column ``score``.
    """
    held, one = docs.sparkSession.sparkContext.broadcast(model), []

    def scores(texts: pa.Array) -> pa.Array:
        if not one:
            one.append(held.value.scorer())
        return pa.array([one[0](t.as_py()) for t in texts], pa.float64())

    small_batches(docs.sparkSession)
    return docs.select(*(keep or [F.col("doc_id")]), F.arrow_udf(scores, "double")(F.col(text)).alias("score"))
