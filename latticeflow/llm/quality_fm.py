"""Quality: a factorisation machine over hashed words, structure statistics and the text's length.

``y(x) = w0 + w.x + 1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]``: the second term holds all pairwise interactions
and takes time linear in the features that are present.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim
from .toxicity import bounded_labelled, in_order

#: Labelled documents that the machine learns from, at most; width of the interactions; buckets of hashed words.
LEARN_ROWS, FACTORS, BUCKETS = 3000, 6, 1 << 12
#: Upper edges that turn a statistic into one of nine levels.
EDGES = (0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75)
LENGTHS = (5, 20, 50, 100, 200, 500, 1000, 5000)
STATS = ("upper", "symbols", "bars", "shouts", "digits", "same_next", "dup_lines", "distinct", "word_length", "words", "chars")
LEVELS = len(EDGES) + 1
DIMENSIONS = len(STATS) * LEVELS + BUCKETS


def statistics(text: str, words: list[bytes], raw: bytes) -> list[float]:
    """Structure of a text: shares between 0 and 1, then mean word length, numbers of words and of characters."""
    n, k = max(1, len(raw)), max(1, len(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"#*$%&<>=_~^"), share(b"|"), share(b"!"), share(b"0123456789"),
        sum(map(eq, words, words[1:])) / k, 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / k,
        n / k / 20, len(words), len(text),
    ]


def levels(stats: list[float]) -> list[int]:
    out = [i * LEVELS + sum(x > e for e in EDGES) for i, x in enumerate(stats[:-2])]
    words, chars = stats[-2:]
    return [*out, (len(STATS) - 2) * LEVELS + sum(words > e for e in LENGTHS), (len(STATS) - 1) * LEVELS + sum(chars > 6 * e for e in LENGTHS)]


class Encoder:
    """Turns a text into feature numbers and values; a word's bucket is computed once and kept."""

    def __init__(self) -> None:
        self.bucket: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        known, ids = self.bucket, set()
        if len(known) > 100_000:
            known.clear()
        for w in set(words):
            i = known.get(w)
            if i is None:
                i = known[w] = len(STATS) * LEVELS + crc32(w) % BUCKETS
            ids.add(i)
        head = levels(statistics(text, words, raw))
        tail = sorted(ids)
        return np.array(head + tail, np.int64), np.concatenate([np.ones(len(head)), np.full(len(tail), 0.5 / np.sqrt(max(1, len(tail))))])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[ids] * values[:, None]
        s = v.sum(0)
        return float(self.bias + self.linear[ids] @ values + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(ids, values), -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 40, rate: float = 0.08, decay: float = 1e-4, seed: int = 11) -> FactorisationMachine:
    """Full-batch adaptive descent on the log loss. With no row, or one class only, the smoothed rate is all that is learnt."""
    y = np.asarray(labels, float)
    p = (y.sum() + 0.5) / (len(y) + 1)
    b, w = float(np.log(p / (1 - p))), np.zeros(DIMENSIONS)
    v = np.random.default_rng(seed).normal(0, 0.05, (DIMENSIONS, FACTORS))
    if len(y) == 0 or y.min() == y.max():
        return FactorisationMachine(b, w, np.zeros_like(v))
    used, col = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    val = np.concatenate([r[1] for r in rows]).astype(np.float32)
    sizes = np.array([len(r[0]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    row = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(col, kind="stable")
    by_col = np.concatenate([[0], np.flatnonzero(np.diff(col[order])) + 1])
    wu, vu = w[used].astype(np.float32), v[used].astype(np.float32)
    state = [np.zeros(1), np.zeros_like(wu), np.zeros_like(vu)]
    for _ in range(epochs):
        xv = vu[col] * val[:, None]
        s = np.add.reduceat(xv, starts, axis=0)
        q = np.add.reduceat(xv * xv, starts, axis=0)
        z = b + np.add.reduceat(wu[col] * val, starts) + 0.5 * (s * s - q).sum(1)
        err = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)).astype(np.float32)
        e = err[row] * val
        gw = np.add.reduceat(e[order], by_col) + decay * wu / len(y)
        gv = np.add.reduceat((e[:, None] * (s[row] - xv))[order], by_col, axis=0) + decay * vu / len(y)
        for k, g in enumerate((np.array([err.sum()]), gw, gv)):
            state[k] = state[k] + g * g
        b -= float(rate * err.sum() / (np.sqrt(state[0][0]) + 1e-8))
        wu = wu - rate * 4 * gw / (np.sqrt(state[1]) + 1e-8)
        vu = vu - rate * gv / (np.sqrt(state[2]) + 1e-8)
    w[used], v = wu, np.zeros_like(v)
    v[used] = vu
    return FactorisationMachine(b, w, v)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder()
    for batch in batches:
        got = [encoder(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["place", "label", "ids", "vals"])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = LEARN_ROWS) -> FactorisationMachine:
    """Fit on at most ``rows`` labelled documents, those with the smallest hash of the key; ``learnable`` is a condition on ``key``.

    A null text counts as empty; rows without a key or label teach nothing; an id repeated among labels or documents counts as often as
    it stands there, within the bound; other columns are not read; without rows the machine knows the smoothed rate only.
    """
    small_batches(docs.sparkSession)
    sample = bounded_labelled(docs, labels, label, text, key, learnable, rows)
    got = sample.mapInArrow(_encode, "place long, label int, ids array<int>, vals array<double>").toArrow()
    ids, values, labels_ = in_order(got, "ids", "vals")
    machine = fit(list(zip(ids, values)), labels_)
    del got, ids, values
    trim()
    return machine


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Columns ``keep`` and ``score`` for every row; a null text is scored like an empty one.

    Whole texts of any length are read; repeated rows are scored alike; an empty table gives an empty one. Other columns are not
    read; ``keep`` may have no column ``score``.
    """
    held, encoder = docs.sparkSession.sparkContext.broadcast(model), Encoder()

    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.score(*encoder(t.as_py())) for t in texts], pa.float64())

    small_batches(docs.sparkSession)
    return docs.select(*(keep or [F.col("doc_id")]), F.arrow_udf(scores, "double")(F.col(text)).alias("score"))
