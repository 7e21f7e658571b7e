"""Removal of byte strings that start anywhere else in the corpus, by a depth-limited radix sort of suffixes.

Suffixes are told apart only through ``DEPTH`` bytes, by most-significant-digit passes; a group that shrinks to one member leaves
after each pass, and the groups that are left after the last pass are exactly the repeated windows.

Pass 1, over all texts. A window's first digit is the least hash of the ``GRAM``-byte strings in it: equal windows have equal
digits. Neighbouring windows whose digit comes from the same place form a run of at most ``DEPTH - GRAM + 1`` windows, and runs, a
hundredth of the number of windows, are what is shuffled. Digits that one run alone has are unique.
Pass 2. Runs of equal bytes are one class: all their windows are repeated. Only classes that share the digit with other classes
go on, one copy each.
Last passes. The windows of these classes are sorted in blocks, digit by digit of ``DIGIT`` bytes up to ``DEPTH``. A digit value
with many classes is first split by where in the window the digit stands and by the bytes that all windows of such a part share.
Digits of more than eight bytes stand in for themselves by 64-bit hashes; two windows are taken as equal if six such values and a
place agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, join_checked, join_counted, small_batches

#: Bytes through which suffixes are compared; bytes of the strings whose hashes are the first digit; bytes of later digits.
DEPTH, GRAM, DIGIT = 200, 32, 40
WINDOWS = DEPTH - GRAM + 1
#: Bytes worked on at once (under 2 ** PLACE); classes sorted in one block; classes from which a digit value is split; windows of its parts.
CHUNK, PLACE, BLOCK_ROWS, HOT, PART = 1 << 19, 20, 2500, 1000, 16
#: Classes of a part from which its windows are sorted each by itself.
BIG = 1000
#: Rows that a worker turns into Python objects at once.
SLICE_ROWS = 500
#: Bytes of spans or classes up to which they are broadcast to the texts; beyond, the texts are shuffled to them.
BROADCAST_BYTES = 48 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes (a multiple of eight) from each position on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(29)
    step = 1
    while step < 8:
        h = (h[:-step] * _M2 + h[step:]) * _M1
        h ^= h >> np.uint64(32)
        step *= 2
    out = h
    for at in range(8, width, 8):
        out = (out[: len(h) - at] * _M2 + h[at:]) * _M1
        out = out ^ (out >> np.uint64(31))
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(out) - (width - step)], out[width - step :]) if step < width else out


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of some texts one after the other (``ends``: where each ends): first start, windows, digit, its place.

    ``data`` is shorter than 2 ** PLACE.
    """
    none = np.zeros(0, np.int64)
    if len(data) < DEPTH:
        return none, none, none.astype(np.uint64), none
    h = gram_hashes(data, GRAM)
    places = np.arange(len(h), dtype=np.uint64)
    least = sliding_least((h >> np.uint64(PLACE) << np.uint64(PLACE)) | places, WINDOWS)
    valid = np.ones(len(least), bool)
    for e in ends[:-1]:
        valid[max(0, e - DEPTH + 1) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none.astype(np.uint64), none
    place = (least[at] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[first], np.diff(np.append(first, len(at))), h[place[first]], place[first]


def text_runs(texts: list[bytes]) -> list[tuple[list[int], list[int], list[int], list[int], list[int]]]:
    """For each text: first starts, numbers of windows, digits, their places in the first window, and hashes of the runs' bytes."""
    out: list[tuple[list[int], list[int], list[int], list[int], list[int]]] = [([], [], [], [], []) for _ in texts]
    pieces, size = [], 0  # (text, from, to)

    def flush() -> None:
        raw = b"".join(texts[k][a:b] for k, a, b in pieces)
        ends = np.cumsum([b - a for _, a, b in pieces])
        starts, counts, digits, places = runs(np.frombuffer(raw, np.uint8), ends)
        which = np.searchsorted(ends, starts, "right")
        for s, n, d, p, k in zip(starts.tolist(), counts.tolist(), digits.view(np.int64).tolist(), places.tolist(), which.tolist()):
            text, a, b = pieces[k]
            got = out[text]
            got[0].append(s - int(ends[k]) + b)
            got[1].append(n)
            got[2].append(d)
            got[3].append(p - s)
            got[4].append(xxh3_64_intdigest(raw[s : s + n + DEPTH - 1]) - (1 << 63))

    for k, t in enumerate(texts):
        for a in range(0, max(0, len(t) - DEPTH + 1), CHUNK):
            b = min(len(t), a + CHUNK + DEPTH - 1)
            if pieces and size + b - a > CHUNK + DEPTH:
                flush()
                pieces, size = [], 0
            pieces.append((k, a, b))
            size += b - a
    if pieces:
        flush()
    return out


def repeated_windows(rows: list[bytes], group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur in two rows or more, as (row, start in the row).

    ``group``: the rows' numbers of digit values; ``place``: where in the first window the digit stands. Windows of different
    groups or places never are equal.
    """
    lengths = np.array([len(r) for r in rows])
    data = np.frombuffer(b"".join(rows), np.uint8)
    starts = np.cumsum(lengths) - lengths
    counts = lengths - DEPTH + 1
    row = np.repeat(np.arange(len(rows)), counts)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[row] + inner
    key = group[row].astype(np.int64) * (WINDOWS + DEPTH) + place[row] - inner
    digit = gram_hashes(data, DIGIT)
    live = np.arange(len(row))
    for depth in range(-1, DEPTH // DIGIT):
        value = key[live] if depth < 0 else digit[at[live] + depth * DIGIT]
        order = np.argsort(value, kind="stable")
        if depth >= 0:
            order = order[np.argsort(key[live][order], kind="stable")]
        live, value = live[order], value[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        if depth >= 0:
            own = key[live]
            new |= np.concatenate([[True], own[1:] != own[:-1]])
        several = ~(new & np.concatenate([new[1:], [True]]))
        number = np.cumsum(new)
        key[live] = number
        live = live[several]
        if not len(live):
            break
    live.sort()
    return row[live], inner[live]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE_ROWS rows: what a worker holds at once does not depend on the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


RUNS = "start array<int>, n array<smallint>, digit array<long>, place array<smallint>, hash array<long>"


def _first_pass(texts: pa.Array) -> pa.Array:
    got = text_runs([t.as_py() for t in texts])
    kinds = (("start", pa.int32()), ("n", pa.int16()), ("digit", pa.int64()), ("place", pa.int16()), ("hash", pa.int64()))
    return pa.StructArray.from_arrays([pa.array([g[j] for g in got], pa.list_(k)) for j, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, hot, uid, start, place, hash, bytes) of the classes to be sorted; hot digit values come in parts."""
    names = ["part", "hot", "uid", "start", "place", "hash", "bytes"]

    def row(part: int, hot: bool, uid: int, start: int, place: int, raw: bytes) -> tuple:
        return part, hot, uid, start, place, xxh3_64_intdigest(raw) - (1 << 63), raw

    for batch in slices(batches):
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("start", "n", "place", "digit", "hot")]
        for uid, text, *todo in zip(batch.column("__uid").to_pylist(), batch.column("__bytes").to_pylist(), *columns):
            for s, n, p, d, hot in zip(*todo):
                if not hot:
                    out.append(row(d, False, uid, s, p, text[s : s + n + DEPTH - 1]))
                    continue
                for offset in range(p // PART, (p - n + 1) // PART - 1, -1):  # windows whose digit stands at [offset * PART, + PART)
                    a, b = max(0, p - offset * PART - PART + 1), min(n - 1, p - offset * PART)
                    core = s + p - offset * PART
                    shared = text[core : core + DEPTH - PART + 1]
                    part = xxh3_64_intdigest(shared, (d + offset) & (2**64 - 1)) - (1 << 63)
                    out.append(row(part, True, uid, s + a, p - a, text[s + a : s + b + DEPTH]))
                    if len(out) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)


def _sort_block(block: pa.Table) -> pa.Table:
    part, place = block.column("part").to_numpy(), block.column("place").to_numpy().astype(np.int64)
    _, group = np.unique(part, return_inverse=True)
    rows = block.column("bytes").to_pylist()
    row, inner = repeated_windows(rows, group, place)
    first = block.column("start").to_numpy().astype(np.int64)
    own = first[row] >= 0
    row, inner = row[own], inner[own]
    uid, start = block.column("uid").to_numpy()[row], first[row] + inner
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return pa.table({"__uid": uid[first], "a": start[first], "b": (start[last] + DEPTH) if len(row) else start})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the rows by itself: its place and the hashes of its halves; start -1 for a class of copies."""
    names, half = ["part", "offset", "first", "second", "uid", "start"], DEPTH // 2
    for batch in slices(batches):
        out: list[tuple] = []
        for part, uid, start, place, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "uid", "start", "place", "bytes"))):
            for i in range(len(raw) - DEPTH + 1):
                first, second = (xxh3_64_intdigest(raw[a : a + half]) - (1 << 63) for a in (i, i + half))
                out.append((part, place - i, first, second, uid, start + i if start >= 0 else -1))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 6, kinds)], names)


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = [[x for ab in merged([(s["a"], s["b"]) for s in found]) for x in ab] for found in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__uid"), pa.array(flat, pa.list_(pa.int32()))], ["__uid", "spans"])


def weight(df: DataFrame, column: str, each: int) -> int:
    """Bytes of a table of arrays, at ``each`` an element and 64 a row."""
    return int(df.agg(F.coalesce(F.sum(F.size(column) * each + 64), F.lit(0))).first()[0])


def repeated_spans(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Per row: ``keep``, ``bytes`` (the text in UTF-8) and ``spans``: a, b, a, b and so on, the maximal spans of bytes a to b that
    repeated windows cover, in order; null if there are none.

    A null text is empty; a text under ``DEPTH`` bytes has no window; repeated rows are copies of each other; an empty table gives
    an empty one. Other columns of ``docs`` are not read, but ``keep`` may have no name that begins with two underscores.
    """
    small_batches(docs.sparkSession)
    given = docs.select(*(keep or [F.col("doc_id")]), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__bytes"))
    kept = [c for c in given.columns if c != "__bytes"]
    first = given.withColumn("__runs", F.arrow_udf(_first_pass, RUNS)("__bytes"))
    texts = cut(first.withColumn("__uid", F.monotonically_increasing_id()), "runs")
    fields = ["start", "n", "digit", "place", "hash"]
    run = texts.select("__uid", F.explode(F.arrays_zip(*(F.col(f"__runs.{f}").alias(f) for f in fields))).alias("r")).select("__uid", "r.*").toDF("uid", *fields)

    several = run.groupBy("digit").agg(F.count(F.lit(1)).alias("runs"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("runs > 1").select("digit", F.expr("lo <> hi").alias("mixed"))
    several = cut(several, "digits")
    met = cut(join_checked(run, several, ["digit"], "inner", several.count(), 2_000_000), "met")
    same = met.filter("not mixed").select(F.col("uid").alias("__uid"), F.col("start").alias("a"), (F.col("start") + F.col("n") + (DEPTH - 1)).alias("b"))

    mixed = met.filter("mixed")
    classes = cut(mixed.groupBy("digit", "hash").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("uid", "start", "n", "place"), F.struct("uid", "start")).alias("one")), "classes")
    # The members of one class may be most rows: those of large classes are not shuffled to it.
    copied = join_counted(mixed, classes.filter("copies > 1").select("digit", "hash", "copies"), ["digit", "hash"], "left_semi", "copies", mixed.count())
    copied = copied.select(F.col("uid").alias("__uid"), F.col("start").alias("a"), (F.col("start") + F.col("n") + (DEPTH - 1)).alias("b"))
    hot = cut(classes.groupBy("digit").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > HOT).select("digit", F.lit(True).alias("hot")), "hot")
    todo = join_checked(classes, hot, ["digit"], "left", hot.count()).select(F.col("one.uid").alias("__uid"), F.struct(F.col("one.start").alias("start"), F.col("one.n").alias("n"), F.col("one.place").alias("place"), "digit", F.col("hot").isNotNull().alias("hot")).alias("c"))
    lists = todo.groupBy("__uid").agg(F.collect_list("c").alias("c"))
    todo = cut(lists.select("__uid", *(F.col(f"c.{f}").alias(f) for f in ("start", "n", "place", "digit", "hot"))), "todo")
    rows = join_checked(texts.select("__uid", "__bytes"), todo, ["__uid"], "inner", weight(todo, "start", 20), BROADCAST_BYTES).mapInArrow(_classes, "part long, hot boolean, uid long, start long, place long, hash long, bytes binary")
    rows = cut(rows, "rows")

    # Parts of hot digit values: equal ones are one class again, and a part that still has many classes is sorted window by window.
    whole = (F.col("start") + F.length("bytes")).alias("b")
    parts = cut(rows.filter("hot").groupBy("part", "place", "hash").agg(F.count(F.lit(1)).alias("copies"), F.min("uid").alias("uid"), F.first("bytes").alias("bytes")), "parts")
    key = ["part", "place", "hash"]
    twice, once = parts.filter("copies > 1").select(*key), parts.filter("copies = 1").select(*key)
    hot_rows = rows.filter("hot").select(*key, "uid", "start", whole)
    # The members of one class may be most rows, the classes are few: they go to the rows, not the rows to them.
    same_parts = join_checked(hot_rows, twice, key, "left_semi", twice.count()).select(F.col("uid").alias("__uid"), F.col("start").alias("a"), "b")
    single = join_checked(hot_rows, once, key, "left_semi", once.count())
    big = cut(parts.groupBy("part").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > BIG).select("part", F.lit(True).alias("big")), "big")
    sized = join_checked(parts, big, ["part"], "left", big.count()).withColumn("big", F.col("big").isNotNull())
    sized = cut(sized.join(single.select(*key, "start"), key, "left"), "sized")
    # A class of copies takes part as a partner only: its windows are known to be repeated.
    few = sized.filter("not big").select("part", "uid", F.coalesce("start", F.lit(-1)).alias("start"), "place", "bytes").unionByName(rows.filter("not hot").select("part", "uid", "start", "place", "bytes"))
    blocks = max(1, few.count() // BLOCK_ROWS)
    sorted_ = few.withColumn("block", F.pmod(F.xxhash64("part"), F.lit(blocks))).groupBy("block").applyInArrow(lambda _, t: _sort_block(t), "__uid long, a long, b long")
    windows = cut(sized.filter("big").select("part", "uid", F.coalesce("start", F.lit(-1)).alias("start"), "place", "bytes").mapInArrow(_windows, "part long, offset int, first long, second long, uid long, start long"), "windows")
    place = ["part", "offset", "first", "second"]
    met_windows = cut(windows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*place), "met")
    by_window = join_checked(windows.filter("start >= 0"), met_windows, place, "left_semi", met_windows.count()).select(F.col("uid").alias("__uid"), F.col("start").alias("a"), (F.col("start") + DEPTH).alias("b"))

    spans = same.unionByName(copied).unionByName(same_parts).unionByName(sorted_).unionByName(by_window).groupBy("__uid").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))).alias("spans"))
    spans = cut(spans.mapInArrow(_merge_spans, "__uid long, spans array<int>"), "spans")
    joined = join_checked(texts.select("__uid", *kept, "__bytes"), spans, ["__uid"], "left", weight(spans, "spans", 4), BROADCAST_BYTES)
    return joined.select(*kept, F.col("__bytes").alias("bytes"), "spans")


def _left(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What is left of texts without their spans: the bytes, and the text without characters of which a cut took a part."""
    out = []
    for raw, found in zip(texts, spans.to_pylist()):
        if not found:
            out.append(None)
            continue
        t = raw.as_py()
        edges = [0, *found, len(t)]
        left = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append({"bytes": left, "text": left.decode("utf-8", "ignore")})
    return pa.array(out, pa.struct([("bytes", pa.binary()), ("text", pa.string())]))


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Per row: ``keep``, ``kept_text``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    The digest is that of all remaining bytes; the text goes without characters of which a cut took a part. Null and empty texts,
    repeated rows and empty tables are as in ``repeated_spans``; ``keep`` may have none of the result's names.
    """
    found = repeated_spans(docs, text, keep)
    kept = found.columns[:-2]
    cuts = F.col("spans").isNotNull()
    left = F.arrow_udf(_left, "bytes binary, text string")(F.when(cuts, F.col("bytes")), "spans")  # only texts with spans go to a worker
    out = found.withColumn("__left", left).withColumn("__bytes", F.when(cuts, F.col("__left.bytes")).otherwise(F.col("bytes")))
    return out.select(
        *kept,
        F.when(cuts, F.col("__left.text")).otherwise(F.col("bytes").cast("string")).alias("kept_text"),
        F.length("bytes").cast("long").alias("n_bytes"),
        (F.length("bytes") - F.length("__bytes")).cast("long").alias("n_removed"),
        F.when(cuts, F.size("spans") / 2).otherwise(0).cast("long").alias("n_spans"),
        F.sha2("__bytes", 256).alias("kept_sha256"),
    )
