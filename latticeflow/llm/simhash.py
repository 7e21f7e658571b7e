"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments, and each segment has a table: its value, and the fingerprints that have it. If two fingerprints
differ in ``r`` bits or fewer, they differ in ``r // m`` bits or fewer in one of their ``m`` segments. So each fingerprint looks up,
in every table, the small Hamming ball of that radius around its own segment, and what it finds there is verified on all bits.

A value that many fingerprints share, as in a large group of near copies, is split by the other segments: its members meet again at
the members of a small ball around all their other bits. Such a meeting place holds only fingerprints within ``r`` bits of its
least one, and their number is bounded by the size of the balls, so each is linked to that one, and no pairs within it are listed.

``near_groups`` does this for fingerprints of 64 bits and a few differing bits, without losing a link. ``similar_groups`` is for texts
with equal shingles: wide fingerprints whose segments are searched with balls on both sides join most of them, then the Jaccard
similarity itself decides on all pairs that share one of their first shingles and are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest, xxh64_intdigest

from .common import cut, join_checked, join_counted, small_batches
from .graph import components

#: Fingerprints of 64 bits: words of a shingle, seed of its hash, differing bits of a link, segments.
WIDTH, SEED, BITS, MOST_BITS, SEGMENTS = 3, 42, 64, 2, 2
#: Fingerprints that a table's value may have before it is split by the other segments.
LIGHT = 16
#: Wide fingerprints: words of a shingle, similarity, longs (each has two segments), bits of a segment that are looked up.
WIDE_WIDTH, LEAST_SIMILARITY, LONGS, SEGMENT_BITS = 5, 0.8, 4, 28
#: Differing bits beyond which two wide fingerprints are not compared by their shingles: 0.8 means 15 % on average.
MOST_WIDE = 62
#: Rows in which common shingles are looked for, in how many of them one is common, and how many are known at most: they only order.
SAMPLE, COMMON, MOST_COMMON = 20_000, 3, 400_000
#: Bytes of a shingle's hash by which prefixes meet: equal ones of unlike shingles only add pairs, which are verified.
TOKEN = 5
TOKEN_MASK = np.uint64((1 << 8 * TOKEN) - 1)
#: Postings that meet in one task, on average; postings of a block; pairs that are listed at once.
SLICE, EMIT, PAIRS = 500_000, 500_000, 1_000_000


def shingles(text: str | None, width: int) -> list[bytes]:
    """Runs of ``width`` words, space-joined, repeats included; all words if they are fewer; none without a word.

    A-Z are lower-cased, words are runs of anything but ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) >= width:
        return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    return [b" ".join(words)] if words else []


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of little-endian hash words, the bits set in over half the rows, as words."""
    total = np.zeros(hashes.shape[1] * BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 without a word."""
    parts = shingles(text, width)
    if not parts:
        return 0
    return int(majority(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64).reshape(-1, 1))[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[Column] | None = None, name: str = "fp", width: int = WIDTH) -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed long.

    Null and empty texts have fingerprint 0; whole texts of any length are read; repeated rows have one fingerprint each; an empty
    table gives an empty one. Other columns are not read; ``keep`` may have no column ``name``.
    """
    small_batches(docs.sparkSession)

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64))

    return docs.select(*(keep or [F.col("doc_id")]), F.arrow_udf(prints, "long")(F.col(text)).alias(name))


def ball(mask: int, radius: int) -> list[tuple[int, int]]:
    """(flipped bits, their number) of the ball of ``radius`` within the bits of ``mask``; as signed longs."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    flips = [(sum(1 << b for b in some), n) for n in range(radius + 1) for some in combinations(bits, n)]
    return [(f - (1 << BITS) if f >> (BITS - 1) else f, n) for f, n in flips]


def masks(segments: int) -> list[int]:
    """The bits of each of ``segments`` segments of nearly equal widths."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, most_bits: int = MOST_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Edges ``(u, v)`` that connect the different fingerprints ``fp`` of ``prints`` as all pairs at ``most_bits`` or less would.

    ``prints`` has each fingerprint once; it is read several times. ``most_bits`` is even: half of it is flipped on either side
    where a value is split. Neither LIGHT nor ``segments`` changes what is connected.
    """
    if most_bits % 2:
        raise ValueError("most_bits must be even")
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    all_masks = masks(segments)
    radius, half = most_bits // segments, most_bits // 2
    table = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for s, m in enumerate(all_masks)))).alias("t")).select("t.*", "fp")
    sizes = cut(table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("one")), "sizes")
    several = sizes.filter(F.col("n").between(2, LIGHT)).select("segment", "value")
    fetched = join_checked(table, several, ["segment", "value"], "left_semi", several.count()).groupBy("segment", "value").agg(F.collect_list("fp").alias("members"))
    single = sizes.filter("n = 1").select("segment", "value", F.array("one").alias("members"))
    heavy = sizes.filter(F.col("n") > LIGHT).select("segment", "value", F.lit(None).cast("array<long>").alias("members"))
    buckets = cut(single.unionByName(fetched).unionByName(heavy), "buckets")

    flips = F.array(*(F.struct(F.lit(s).alias("segment"), F.lit(signed(m)).alias("mask"), F.lit(f).alias("flip"), F.lit(n).alias("away")) for s, m in enumerate(all_masks) for f, n in ball(m, radius)))
    probes = prints.select("fp", F.explode(flips).alias("p")).select("fp", "p.segment", "p.away", F.col("fp").bitwiseXOR(F.col("p.flip")).bitwiseAND(F.col("p.mask")).alias("value"))
    # Of the probes few meet anything: they are shuffled once, at any size, and what they met is written.
    met = cut(probes.join(buckets.hint("shuffle_hash"), ["segment", "value"]).filter("size(members) > 1 or members is null or members[0] <> fp"), "met")
    near = F.expr(f"u <> v and bit_count(u ^ v) <= {most_bits}")
    found = met.filter("members is not null").select(F.col("fp").alias("u"), F.explode("members").alias("v")).filter(near)

    split = None
    hot = cut(met.filter("members is null").select("segment", "value", "fp", "away"), "hot")
    for s, m in enumerate(all_masks):
        rest = ((1 << BITS) - 1) ^ m
        for away in range(radius + 1):
            around = [f for f, _ in ball(rest, half if away == 0 else max(0, most_bits - away - half))]
            part = hot.filter((F.col("segment") == s) & (F.col("away") == away))
            part = part.select("segment", "value", "fp", "away", F.explode(F.array(*map(F.lit, around))).alias("flip")).withColumn("place", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(signed(rest)))).drop("flip")
            split = part if split is None else split.unionByName(part)
    places = split.groupBy("segment", "value", "place").agg(F.min(F.when(F.col("away") == 0, F.col("fp"))).alias("v"), F.collect_list("fp").alias("members"))
    by_place = places.filter("v is not null and size(members) > 1").select("v", F.explode("members").alias("u")).filter(near)
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(by_place.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct()


def near_groups(prints: DataFrame, key: str = "doc_id", most_bits: int = MOST_BITS, segments: int = SEGMENTS) -> DataFrame:
    """``prints`` (any columns, with ``fp``) and ``component``: the least ``key`` among all rows reachable by links.

    ``prints`` is read more than once: pass files. Equal fingerprints form one node, so copies need no pairs. Null keys never are
    the least one; a component of null keys only has a null id. An empty table gives an empty one.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("__n")), "nodes")
    roots = cut(components(links(nodes.select("fp"), most_bits, segments)), "roots").withColumnRenamed("u", "fp")
    rooted = cut(join_checked(nodes, roots, ["fp"], "left", roots.count()).select("fp", F.coalesce("root", "fp").alias("root"), "least", "__n"), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_print = cut(rooted.join(named, "root").select("fp", "component", "__n"), "named")
    rows = int(by_print.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
    return join_counted(prints, by_print, ["fp"], "inner", "__n", rows)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The text's different shingles as sorted 64-bit hashes."""
    return np.unique(np.fromiter(map(xxh3_64_intdigest, set(shingles(text, width))), np.uint64))


def digests(parts: list[bytes], seed: int = 0) -> np.ndarray:
    """Two 64-bit hashes of each shingle."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, parts, repeat(seed))), "<u8").reshape(-1, 2)


def wide_print(text: str | None, width: int) -> tuple[list[int], int, np.ndarray]:
    """The wide fingerprint of the text's different shingles, a hash of their set, and their sorted 64-bit hashes; zeros without a word."""
    parts = list(set(shingles(text, width)))
    if not parts:
        return [0] * LONGS, 0, np.zeros(0, np.uint64)
    raw = [digests(parts, seed) for seed in range((LONGS + 1) // 2)]
    bits = majority(np.ascontiguousarray(np.concatenate(raw, axis=1)[:, :LONGS]))
    first = np.sort(raw[0][:, 0])
    return bits.view(np.int64).tolist(), xxh3_64_intdigest(first.tobytes()) - (1 << 63), np.unique(first)


def prefix(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first of a text's different shingles, by hash, those in ``common`` (sorted) last, each by its last TOKEN bytes. Two texts with
    a similarity of ``least`` or more share one of them: what is left out of either is too little for their overlap.
    """
    tokens = found & TOKEN_MASK
    if not len(common):
        last = np.zeros(len(found), bool)
    else:  # ``common`` is sorted and long: it is looked up, not gone through for each text
        last = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
    return np.concatenate([tokens[~last], tokens[last]])[: len(found) - ceil(least * len(found) - 1e-9) + 1]


def packed(tokens: np.ndarray) -> bytes:
    """Numbers as TOKEN bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN, 8), np.uint8)
    out[:, :TOKEN] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN)
    return out.view("<u8").ravel()


def planes(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte by byte: bytes that are zero in all rows are runs, which any codec of a shuffle takes away."""
    return b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)


def from_planes(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(c.T).view("<u4").ravel().astype(np.int64) for c in raw]


def parities(found: np.ndarray) -> bytes:
    """A bit for each of at least twice as many buckets as hashes: whether their number in it is odd. A power of two of bytes, eight at least."""
    bits = max(64, 2 << max(0, len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A number of elements by which two sets differ at least, by their parities: the larger one is folded to the smaller one's buckets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, text: str, order: str, width: int) -> np.ndarray:
    """Shingles that many of SAMPLE rows have, at most MOST_COMMON. Which ones they are changes the work, never what is found."""
    part = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(order)).alias("h")).filter(F.pmod("h", F.lit(max(1, docs.count() // SAMPLE))) == 0)
    slices = 16

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.concatenate([digests(list(set(shingles(t.as_py(), width))))[:, 0] for t in batch.column(0)]) & TOKEN_MASK
            at = tokens % np.uint64(slices)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "tokens": pa.array([packed(tokens[at == s]) for s in range(slices)], pa.binary())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpacked(x.as_py()) for batch in batches for x in batch.column("tokens")]
        tokens, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_pydict({"token": tokens[n >= COMMON].view(np.int64), "n": n[n >= COMMON].astype(np.int64)})

    dealt_out = part.select("t").mapInArrow(dealt, "slice int, tokens binary")
    top = dealt_out.groupBy("slice").applyInArrow(counted, "token long, n long").orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toArrow()
    return np.sort(np.asarray(top.column(0), np.int64).view(np.uint64))


def meetings(token: np.ndarray, num: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (u, v), u > v, of the ``num`` of postings of one token under different ``root`` s that can have a similarity of ``least`` or more.

    At each token the postings of all roots but its most frequent one are paired with all postings of a fitting size. What two share from
    the place ``at`` on has to be enough for both. Pairs are listed in parts of bounded size; a pair can come more than once.
    """
    order = np.lexsort((size, token))
    token, num, root, size, at = (x[order] for x in (token, num, root, size, at))
    group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
    roots, root = np.unique(root, return_inverse=True)
    which, inverse, n = np.unique(group * (len(roots) + 1) + root, return_inverse=True, return_counts=True)
    by_group = np.lexsort((n, which // (len(roots) + 1)))
    of = (which // (len(roots) + 1))[by_group]
    most = np.zeros(len(which), bool)
    most[by_group[np.concatenate([of[1:] != of[:-1], [True]])[: len(of)]]] = True
    is_most = most[inverse]
    few = np.flatnonzero(~is_most)
    key = group * (1 << 33) + size
    lo = np.searchsorted(key, group[few] * (1 << 33) + np.ceil(least * size[few] - 1e-6).astype(np.int64), "left")
    hi = np.searchsorted(key, group[few] * (1 << 33) + np.floor(size[few] / least + 1e-6).astype(np.int64), "right")
    ends = np.cumsum(hi - lo)
    start = 0
    while start < len(few):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        counts = (hi - lo)[start:stop]
        i = np.repeat(few[start:stop], counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[start:stop], counts)
        enough = np.minimum(size[i] - at[i], size[j] - at[j]) >= least / (1 + least) * (size[i] + size[j]) - 1e-6
        ok = enough & (root[i] != root[j]) & (is_most[j] | (j > i))
        i, j = num[i[ok]], num[j[ok]]
        both = np.unique(np.stack([np.maximum(i, j), np.minimum(i, j)]), axis=1) if len(i) else np.zeros((2, 0), np.int64)
        yield both[0], both[1]
        start = stop


def apart_pairs(printed: DataFrame, nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """All pairs (u, v), u > v, of the ``num`` of first rows of ``printed`` (order, num, node, size, prefix) under different ``roots``
    (node, root; a node itself where it has none) that can have a similarity of ``least`` or more.

    Two such share a shingle of their prefixes. Postings are dealt out by shingle in blocks of bytes, a shuffle of some seven bytes each, and
    paired where they meet: ``meetings``.
    """
    special = cut(nodes.filter("n > 1").select("node", "least").join(roots, "node", "full_outer"), "special")
    first = join_checked(printed.select("order", "num", "node", "size", "prefix"), special, ["node"], "left", special.count()).filter("least is null or order = least").select("num", "size", "prefix", "root")
    postings = int(printed.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0]) // TOKEN
    slices = max(1, ceil(postings / SLICE))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, int | None]] = []

        def out() -> pa.RecordBatch:
            base = held[0][0]
            lengths = np.array([len(h[2]) for h in held])
            token = np.concatenate([h[2] for h in held])
            row = np.repeat(np.arange(len(held)), lengths)
            at = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            num, size = np.array([h[0] - base for h in held]), np.array([h[1] for h in held])
            rooted = np.array([h[3] is not None for h in held])
            root = np.array([h[3] or 0 for h in held], np.int64)
            slot = (token % np.uint64(slices)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            found = []
            for some in np.split(order, np.cumsum(np.bincount(slot, minlength=slices))[:-1]):
                if len(some):
                    rows = row[some]
                    known = np.unique(rows[rooted[rows]])
                    step = np.diff(num[rows], prepend=0)
                    found.append((int(slot[some[0]]), base, packed(token[some]), planes(step, size[rows], at[some]), planes(num[known]), root[known].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["slice", "base", "tokens", "places", "rooted", "roots"])

        total = 0
        for batch in batches:
            for num, size, data, root in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held and (total > EMIT or not held[-1][0] < num < held[0][0] + (1 << 32)):
                    yield out()
                    held, total = [], 0
                if data:
                    held.append((num, size, unpacked(data), root))
                    total += len(data) // TOKEN
        if held:
            yield out()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        known_num, known_root = [], []
        for batch in batches:
            for _, base, tokens, places, rooted, roots in zip(*(c.to_pylist() for c in batch.columns)):
                step, size, at = from_planes(places, 3)
                for part, x in zip(parts, (unpacked(tokens), base + np.cumsum(step), size, at)):
                    part.append(x)
                known_num.append(base + from_planes(rooted, 1)[0])
                known_root.append(np.frombuffer(roots, np.int64))
        token, num, size, at = (np.concatenate(p) for p in parts[:4])
        numbers, where, n = np.unique(token, return_inverse=True, return_counts=True)
        some = n[where] > 1
        token, num, size, at = token[some], num[some], size[some], at[some]
        # A root's number is under zero, that of a row without one is its own.
        named, of = np.unique(np.concatenate(known_root), return_inverse=True)
        have, first = np.unique(np.concatenate(known_num), return_index=True)
        root = num.copy()
        if len(have):
            found = np.minimum(np.searchsorted(have, num), len(have) - 1)
            root = np.where(have[found] == num, -1 - of[first][found], num)
        for u, v in meetings(token, num, root, size, at, least):
            yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    blocks = first.mapInArrow(dealt, "slice int, base long, tokens binary, places binary, rooted binary, roots binary")
    return blocks.groupBy("slice").applyInArrow(paired, "u long, v long").distinct()


def candidates(nodes: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Pairs ``(u, v)``, u > v, of the ``node`` s of ``nodes`` (node, fp) whose wide fingerprints agree in a segment but for two bits.

    The nodes with one value in a segment are paired with the least of them, which stands for them. Each value is posted with its
    ball of radius 1, so two that differ in two bits meet; all that meet are paired with the least, and the least with the greatest.
    A crowd gives a number of pairs in proportion to it.
    """
    low = (1 << segment_bits) - 1
    segments = [f"{s * (1 << 48)}L + (shiftrightunsigned(fp[{s // 2}], {32 * (s % 2)}) & {low}L)" for s in range(2 * LONGS)]
    own = nodes.select("node", F.explode(F.expr(f"array({', '.join(segments)})")).alias("value"))
    values = cut(own.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")), "segments")
    shared = values.filter("n > 1")
    same = join_counted(own, shared, ["value"], "inner", "n", 2 * LONGS * nodes.count()).filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    around = F.explode(F.expr(f"transform(sequence(0, {segment_bits}), b -> if(b = 0, 0L, shiftleft(1L, b - 1)))")).alias("flip")
    posted = values.select("least", "value", around).select("least", F.col("value").bitwiseXOR(F.col("flip")).alias("place"))
    # Hardly two rows of a part share a place, so they are dealt out as they are and only then counted.
    met = cut(posted.repartition("place").groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("lo"), F.max("least").alias("hi")).filter("n > 1"), "met")
    crowds = met.filter("n > 2").select("place", "lo")
    more = join_checked(posted, crowds, ["place"], "inner", crowds.count()).select(F.col("least").alias("u"), F.col("lo").alias("v"))
    pairs = same.unionByName(met.select(F.col("hi").alias("u"), F.col("lo").alias("v"))).unionByName(more)
    return pairs.filter("u <> v").distinct()


def similar_groups(docs: DataFrame, text: str = "text", order: str = "doc_id", width: int = WIDE_WIDTH, least: float = LEAST_SIMILARITY, segment_bits: int = SEGMENT_BITS, most: int = MOST_WIDE) -> DataFrame:
    """``(order, component)`` for every row: the least ``order`` (a column of any orderable type, unlike in all rows) of its group.

    A group is what links connect; a link is a Jaccard similarity of ``least`` or more between the sets of shingles of ``width``
    words, verified on whole texts; none is left out (by 64-bit hashes of shingles). Texts with equal sets are one node; all texts
    without a word, null ones too, are one group; repeated rows are copies; an empty table gives an empty one. Other columns are not
    read. ``docs`` is read more than once: pass files. Meeting places stay small up to about 2 ** segment_bits texts.

    First texts of near fingerprints, ``most`` bits at most, are joined: each with the least of those it meets, which joins most of a
    crowd, then all that meet and are still apart. Then all pairs under different roots whose prefixes allow a link are verified.
    """
    small_batches(docs.sparkSession)
    common = common_shingles(docs, text, order, width)

    def prints(texts: pa.Array) -> pa.Array:
        got = [wide_print(t.as_py(), width) for t in texts]
        columns = [
            pa.array([g[0] for g in got], pa.list_(pa.int64())),
            pa.array([g[1] for g in got], pa.int64()),
            pa.array([len(g[2]) for g in got], pa.int32()),
            pa.array([packed(prefix(g[2], common, least)) for g in got], pa.binary()),
            pa.array([parities(g[2]) for g in got], pa.binary()),
        ]
        return pa.StructArray.from_arrays(columns, ["fp", "node", "size", "prefix", "parity"])

    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in texts], pa.list_(pa.int64()))

    def can(u_size: pa.Array, u_parity: pa.Array, v_size: pa.Array, v_parity: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (u_size, u_parity, v_size, v_parity)))
        return pa.array([least_difference(a, b) <= (1 - least) / (1 + least) * (m + n) + 1e-6 for m, a, n, b in rows], pa.bool_())

    what = "fp array<long>, node long, size int, prefix binary, parity binary"
    described = docs.select(F.col(order).alias("order"), F.arrow_udf(prints, what)(F.col(text)).alias("p"))
    printed = cut(described.select("order", F.monotonically_increasing_id().alias("num"), "p.*"), "printed")
    nodes = cut(printed.groupBy("node").agg(F.min("order").alias("least"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "wide")
    side = lambda df, c, value: df.select(F.col("node").alias(c), F.col(value).alias(f"{c}_{value}"))
    away = " + ".join(f"bit_count(u_fp[{i}] ^ v_fp[{i}])" for i in range(LONGS))

    def near_prints(pairs: DataFrame) -> DataFrame:
        return pairs.join(side(nodes, "u", "fp"), "u").join(side(nodes, "v", "fp"), "v").filter(f"{away} <= {most}").select("u", "v")

    def possible(pairs: DataFrame) -> DataFrame:
        """Of pairs of ``num`` those whose parities allow a link, as pairs of ``node``."""
        met = cut(pairs, "met")
        wanted = cut(met.select(F.explode(F.array("u", "v")).alias("num")).distinct(), "wanted")
        known = cut(join_checked(printed.select("num", "node", "size", "parity"), wanted, ["num"], "left_semi", wanted.count()), "parities")
        end = lambda c: known.select(F.col("num").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("node", "size", "parity")))
        both = met.join(end("u"), "u").join(end("v"), "v").filter(F.arrow_udf(can, "boolean")("u_size", "u_parity", "v_size", "v_parity"))
        return both.select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are links. A set goes to the other one of each pair; sets are made where the texts are read."""
        near = cut(pairs, "near")
        ends = near.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("to")).join(near.select(F.col("v").alias("node"), F.lit(True).alias("own")).distinct(), "node", "full_outer")
        wanted = cut(ends.join(nodes.select("node", "least"), "node"), "wanted")
        texts = join_checked(docs.select(F.col(order).alias("least"), F.col(text).alias("t")), wanted, ["least"], "inner", wanted.count())
        shingled = lambda df, *keep: df.select(*keep, F.arrow_udf(sets, "array<long>")("t").alias("set"))
        us = shingled(texts.filter("to is not null"), "node", "to").select(F.col("node").alias("u"), F.explode("to").alias("v"), F.col("set").alias("u_set"))
        vs = shingled(texts.filter("own"), F.col("node").alias("v")).withColumnRenamed("set", "v_set")
        both = us.join(vs, "v").withColumn("common", F.size(F.array_intersect("u_set", "v_set")))
        return cut(both.filter(F.col("common") >= least * (F.size("u_set") + F.size("v_set") - F.col("common")) - 1e-9).select("u", "v"), "links")

    def roots(found: DataFrame) -> DataFrame:
        return cut(components(found), "roots").withColumnRenamed("u", "node")

    def still_apart(pairs: DataFrame, now: DataFrame) -> DataFrame:
        size = now.count()
        found = join_checked(join_checked(pairs, side(now, "u", "root"), ["u"], "left", size), side(now, "v", "root"), ["v"], "left", size)
        found = found.select("u", "v", F.coalesce("u_root", "u").alias("u_root"), F.coalesce("v_root", "v").alias("v_root"))
        return cut(found.filter("u_root <> v_root"), "apart")

    pairs = cut(candidates(nodes.select("node", "fp"), segment_bits), "pairs")
    first = verified(near_prints(pairs.groupBy("u").agg(F.min("v").alias("v"))))
    first = first.unionByName(verified(near_prints(still_apart(pairs, roots(first)).select("u", "v"))))
    now = roots(first)
    # Of the pairs between two roots one is verified first; all that its link does not join follow.
    rest = still_apart(possible(apart_pairs(printed, nodes, now, least)), now)
    one = rest.groupBy(F.greatest("u_root", "v_root"), F.least("u_root", "v_root")).agg(F.min(F.struct("u", "v")).alias("p")).select("p.*")
    one = cut(one, "one")
    first = first.unionByName(verified(one))
    now = roots(first)
    left = still_apart(rest.select("u", "v").join(one, ["u", "v"], "left_anti"), now)
    now = roots(first.unionByName(verified(left.select("u", "v"))))
    rooted = cut(join_checked(nodes.drop("fp"), now, ["node"], "left", now.count()).select("node", F.coalesce("root", "node").alias("root"), "least", "n"), "rooted")
    by_node = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component", "n"), "named")
    rows = int(by_node.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return join_counted(printed.select("order", "node"), by_node, ["node"], "inner", "n", rows).select("order", "component")
