"""Packing of tokenised documents into sequences by patterns of lengths.

The histogram of piece lengths, no longer than the capacity, comes to the driver. Patterns are all ways to fill a sequence with up
to three pieces; non-negative least squares fits how often each is repeated, the counts are rounded down to what is there, and the
pieces left over go best-fit decreasing into what fits tightest. The plan maps the k-th piece of a length to a sequence and an
offset, in runs whose number depends on the capacity alone; ranks k are counted by partition, so no length gathers in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_checked

CAPACITY, END = 1024, 2
#: Steps of the least-squares fit, each of which sets one pattern's count to its best value.
FIT_STEPS = 3000
#: Weight of a length in the fit: its share of the capacity to this power.
WEIGHT_POWER = 4
#: Fixed value: how byte-level BPE splits a text into the pieces that merges stay in.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Byte strings and their ids, which also are the order of merges, and the ids of special strings."""

    ranks: dict[bytes, int]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a byte-level BPE file of the ``tokenizers`` library; a file whose merges are not in the order of ids is refused."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        byte, vocab = byte_symbols(), spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("merges are not in the order of their ids")
        return cls({bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}, special)

    def encoder(self):
        """A function from a text to its ids as little-endian unsigned 32-bit integers, the end id included."""
        import re

        import tiktoken

        encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})
        between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        end = np.array([END], "<u4")

        def encode(text: str) -> np.ndarray:
            if between is None or not between.search(text):
                return np.concatenate([encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4"), end])
            parts = [np.array([self.special[p]], "<u4") if p in self.special else encoding.encode_to_numpy(p, disallowed_special=()).astype("<u4") for p in between.split(text) if p]
            return np.concatenate([*parts, end])

        return encode


@dataclass
class Plan:
    """Runs of pieces by length: pieces ``first[i]`` onwards of a length go to sequences ``sequence[i]`` onwards at ``offset[i]``."""

    first: dict[int, list[int]] = field(default_factory=dict)
    sequence: dict[int, list[int]] = field(default_factory=dict)
    offset: dict[int, list[int]] = field(default_factory=dict)
    sequences: int = 0

    def put(self, length: int, first: int, sequence: int, offset: int) -> None:
        self.first.setdefault(length, []).append(first)
        self.sequence.setdefault(length, []).append(sequence)
        self.offset.setdefault(length, []).append(offset)


def patterns(lengths: list[int], capacity: int) -> np.ndarray:
    """Rows of three ascending lengths, 0 for none, that fill the capacity exactly."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    out = []
    for a in [0, *lengths]:
        if a * 3 > capacity:
            break
        b = np.array([x for x in [0, *lengths] if a <= x <= (capacity - a) // 2 and (x or not a)], int)
        c = capacity - a - b
        ok = have[c] & (c >= b)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Weighted non-negative least squares of the patterns' counts against the histogram, by the coordinate with the best step.

    A piece left over costs the more the longer it is, as short ones still fit somewhere.
    """
    x = np.zeros(len(rows))
    weight = (np.arange(len(histogram)) / (len(histogram) - 1)) ** WEIGHT_POWER
    rest = histogram * weight
    norm = np.zeros(len(rows))
    for i in range(3):
        for j in range(3):
            norm += ((rows[:, i] == rows[:, j]) & (rows[:, i] > 0)) * weight[rows[:, i]]
    for _ in range(steps if len(rows) else 0):
        gain = rest[rows[:, 0]] + rest[rows[:, 1]] + rest[rows[:, 2]]
        move = np.maximum(gain / norm, -x)
        j = int(np.argmax(np.abs(move) * np.sqrt(norm)))
        if abs(move[j]) < 0.5:
            break
        x[j] += move[j]
        for k in rows[j]:
            if k:
                rest[k] -= move[j] * weight[k]
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length from 1 to ``capacity``. Nothing to pack gives an empty plan."""
    out, left = Plan(), np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    rows = patterns([int(x) for x in np.flatnonzero(left)], capacity)
    counts = fit_counts(rows, left)
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] < 1:
            break
        parts = [int(p) for p in rows[j] if p]
        n = min(int(counts[j]), *(int(left[p]) // parts.count(p) for p in parts))
        if n <= 0:
            continue
        at = 0
        for p in reversed(parts):
            out.put(p, int(used[p]), out.sequences, at)
            used[p] += n
            left[p] -= n
            at += p
        out.sequences += n
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, number)
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = min((r for r in room if r >= length), default=None)
            if fits is None:
                per = min(capacity // length, int(left[length]))
                n = int(left[length]) // per
                start, free = out.sequences, capacity
                out.sequences += n
            else:
                start, n = room[fits].pop()
                if not room[fits]:
                    del room[fits]
                take = min(n, int(left[length]))
                if take < n:
                    room.setdefault(fits, []).append((start + take, n - take))
                n, free = take, fits
                per = 1
            for _ in range(per):
                out.put(length, int(used[length]), start, capacity - free)
                used[length] += n
                left[length] -= n
                free -= length
            if free:
                room.setdefault(free, []).append((start, n))
    return out


def pieces(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[Column] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows ``keep``, piece, start, length, ids_crc32, and the place ``(__part, __k)`` of the piece among those of its length.

    A null text is empty and still has the end id. A document of more than ``capacity`` ids is cut from its end into pieces of
    that size; what remains in front is the first piece.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = held.value.encoder(), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            row, number, start, length, crc, k = [], [], [], [], [], []
            for i, t in enumerate(batch.column(0)):
                ids = encode(t.as_py() or "")
                first = len(ids) % capacity
                cuts = [0, *range(first or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    number.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(ids[a:b].tobytes()))
                    k.append(int(seen[b - a]))
                    seen[b - a] += 1
            kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[1:]]
            more = [pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(row), pa.int32()), pa.array(k, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *more], [*batch.schema.names[1:], "piece", "start", "length", "ids_crc32", "__part", "__k"])

    given = docs.select(F.col(text).alias("__text"), *(keep or [F.col("doc_id")]))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[1:])
    return given.mapInArrow(rows, f"{fields}piece int, start long, length long, ids_crc32 long, __part int, __k long")


def pack(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[Column] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: no sequence holds more than ``capacity`` ids, without gaps from 0.

    Repeated rows are packed each on their own; a document's other columns do not matter.
    """
    cut_ = cut(pieces(docs, vocabulary, text, keep, capacity), "pieces")
    counts = cut(cut_.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("__part", "length", F.coalesce(before, F.lit(0)).alias("__base"))
    made = plan(histogram, capacity)
    ordered: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length, first in made.first.items():
        by = np.argsort(first)
        ordered[length] = tuple(np.array(x, np.int64)[by] for x in (first, made.sequence[length], made.offset[length]))
    held = docs.sparkSession.sparkContext.broadcast(ordered)
    kept = [c for c in cut_.columns if not c.startswith("__")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = held.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__k").to_numpy() + batch.column("__base").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                own = length == one
                first, start, at = runs[int(one)]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = start[i] + rank[own] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    placed = join_checked(cut_, bases, ["__part", "length"], "inner", counts.count())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_.schema.fields if f.name in kept)
    return placed.mapInArrow(place, f"{fields}, sequence_id long, offset long")
