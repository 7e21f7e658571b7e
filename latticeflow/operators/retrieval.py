"""Retrieval: similarity top-k, ranks of the true partner, metrics, and the symmetric in-batch loss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import BROADCAST_ROWS, cut, with_batches

#: Vectors of a block at most and at least, bytes of packed queries that are broadcast, of a batch for a worker, and pairs computed at once.
BLOCK, LEAST_BLOCK, BROADCAST_BYTES, BATCH_BYTES, SLICE = 4096, 256, 48 << 20, 4 << 20, 1 << 21


def similarity(queries: DataFrame, items: DataFrame, query: str, item: str, q_vec: str, i_vec: str, block: list[str] | None = None) -> DataFrame:
    """Scores of a stated query set against all items (``block`` columns restrict both to the same block)."""
    q = queries.select(*(block or []), F.col(query).alias("query"), F.col(q_vec).alias("__q"))
    i = items.select(*(block or []), F.col(item).alias("item"), F.col(i_vec).alias("__i"))
    both = q.join(i, block) if block else F.broadcast(q).crossJoin(i) if q.limit(10_001).count() <= 10_000 else q.crossJoin(i)
    return both.select(*(block or []), "query", "item", S.dot(F.col("__q"), F.col("__i")).alias("score"))


def top_items(scores: DataFrame, k: int, wanted: Column | None = None, pool: int | None = None) -> DataFrame:
    """The k best items a query among those ``wanted``, out of the first ``pool`` by score (over-fetch, then filter)."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    first = scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= (pool or max(6 * k, 24) if wanted is not None else k))
    if wanted is None:
        return first
    return first.filter(wanted).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def partner_ranks(scores: DataFrame, query: str = "query", item: str = "item") -> DataFrame:
    """Per query, the rank of the item with the query's own id: 1 and the number of items scored higher, ties by item."""
    true = scores.filter(F.col(query) == F.col(item)).select(query, F.col("score").alias("__t"))
    ahead = (F.col("score") > F.col("__t")) | ((F.col("score") == F.col("__t")) & (F.col(item) < F.col(query)))
    return scores.join(true, query).groupBy(query).agg((F.count_if(ahead) + 1).alias("rank"))


def vector_matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array as rows of one width, and where they hold a value; what a row lacks is 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    full, held = np.zeros((len(sizes), int(sizes.max(initial=0)))), np.zeros((len(sizes), int(sizes.max(initial=0))), bool)
    held[row, at] = np.asarray(flat.is_valid())
    full[row, at] = np.asarray(flat.cast("double").fill_null(0.0))
    return full, held


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, most - a.shape[1]))), np.pad(b, ((0, 0), (0, most - b.shape[1])))


def exact_dots(a: np.ndarray, a_held: np.ndarray, b: np.ndarray, b_held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the sum of products from the first place to the last, as SQL adds them, without those of a missing value, and
    whether there is any product.
    """
    total, some = np.zeros(len(a)), np.zeros(len(a), bool)
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            both = a_held[:, d] & b_held[:, d]
            total, some = np.where(both, total + a[:, d] * b[:, d], total), some | both
    return total, some


def count_ahead(q: tuple, i: tuple) -> np.ndarray:
    """How many items (ids, vectors, held) are ahead of each query's own (ids, own scores, vectors, held): higher, or equal with a
    lesser id; NaN is equal to itself and above all.

    A matrix product decides wherever its rounding cannot matter; the other pairs are added up in the order of SQL.
    """
    (q_id, own, qv, qh), (i_id, iv, ih) = q, i
    (qv, iv), (qh, ih) = same_width(qv, iv), same_width(qh, ih)
    ahead = np.zeros(len(q_id), np.int64)
    plain = bool(qh.all() and ih.all() and qv.shape[1] and np.isfinite(qv).all() and np.isfinite(iv).all() and np.isfinite(own).all())
    step = max(1, SLICE // max(1, len(i_id)))
    slack = 4 * (qv.shape[1] + 1) * np.finfo(float).eps * np.linalg.norm(iv, axis=1) if plain else None
    if plain and not np.isfinite(slack).all():
        plain = False
    for a in range(0, len(q_id), step):
        rows = slice(a, a + step)
        if plain:
            over = qv[rows] @ iv.T - own[rows, None]
            bound = np.linalg.norm(qv[rows], axis=1)[:, None] * slack + np.finfo(float).tiny
            ahead[rows] = (over > bound).sum(1)
            x, y = np.nonzero(~(np.abs(over) > bound))
        else:
            x, y = map(np.ravel, np.indices((len(q_id[rows]), len(i_id))))
        for b in range(0, len(x), SLICE // 8):
            u, v = x[b : b + SLICE // 8] + a, y[b : b + SLICE // 8]
            score, some = exact_dots(qv[u], qh[u], iv[v], ih[v])
            t = own[u]
            higher = (score > t) | (np.isnan(score) & ~np.isnan(t))
            equal = (score == t) | (np.isnan(score) & np.isnan(t))
            np.add.at(ahead, u[some & (higher | equal & (i_id[v] < q_id[u]))], 1)
    return ahead


def block_ranks(queries: DataFrame, items: DataFrame, query: str, item: str, q_vec: str, i_vec: str) -> DataFrame:
    """(query, rank): what ``partner_ranks`` of all scores gives, for long ids, without a row a pair. Every query is compared with all items.

    Vectors are packed into blocks, and each block of queries meets each block of items in one row; it becomes a count a query. The
    packed queries are broadcast if they were counted to be small, else the two sides are multiplied. A query without an item of its id
    is left out, one whose own score is null has rank 1; missing values and places have no product.
    """
    conf = queries.sparkSession.conf
    most = (conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) or "").removesuffix("b")
    if not most.isdigit() or not 0 < int(most) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    q = queries.select(F.col(query).cast("long").alias("query"), F.col(q_vec).alias("v")).filter("query is not null")
    i = items.select(F.col(item).cast("long").alias("item"), F.col(i_vec).alias("v")).filter("item is not null")
    n = items.count()
    rows = min(BLOCK, max(LEAST_BLOCK, n // (4 * queries.sparkSession.sparkContext.defaultParallelism) + 1))
    own = q.join(i.select(F.col("item").alias("query"), F.col("v").alias("other")), "query").withColumnRenamed("v", "mine")
    asked = q.join(own, "query")

    def packed(batches, with_own):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                v, held = vector_matrix(part.column(1))
                columns = [np.asarray(part.column(0), np.int64).tobytes(), v.tobytes(), np.packbits(held).tobytes(), len(v)]
                if with_own:
                    (a, b), (ah, bh) = (same_width(x, y) for x, y in zip(vector_matrix(part.column(2)), vector_matrix(part.column(3))))
                    t, some = exact_dots(a, ah, b, bh)
                    columns += [t.tobytes(), np.packbits(some).tobytes()]
                yield pa.RecordBatch.from_pylist([dict(zip(names[: len(columns)], columns))], pa.schema(list(zip(names, types))[: len(columns)]))

    names, types = ("ids", "vectors", "held", "n", "own", "some"), (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
    fields = "ids binary, vectors binary, held binary, n long"
    q_blocks = cut(asked.select("query", "v", "mine", "other").mapInArrow(lambda b: packed(b, True), f"{fields}, own binary, some binary"), "query-blocks")
    q_blocks = q_blocks.select(*(F.col(c).alias(f"q_{c}") for c in q_blocks.columns))
    i_blocks = cut(i.mapInArrow(lambda b: packed(b, False), fields), "item-blocks").repartition(max(1, -(-n // rows)))
    size = q_blocks.agg(F.coalesce(F.sum("q_n"), F.lit(0)), F.coalesce(F.sum(F.length("q_vectors")), F.lit(0))).first()
    small = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES
    met = i_blocks.crossJoin(F.broadcast(q_blocks)) if small else i_blocks.hint("shuffle_replicate_nl").crossJoin(q_blocks)

    def block(r, s):
        v = np.frombuffer(r[f"{s}vectors"]).reshape(r[f"{s}n"], -1)
        return v, np.unpackbits(np.frombuffer(r[f"{s}held"], np.uint8), count=v.size).astype(bool).reshape(v.shape)

    def counted(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids, t = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_own"])
                some = np.unpackbits(np.frombuffer(r["q_some"], np.uint8), count=len(t)).astype(bool)
                v, held = block(r, "q_")
                ahead = np.zeros(len(ids), np.int64)
                ahead[some] = count_ahead((ids[some], t[some], v[some], held[some]), (np.frombuffer(r["ids"], np.int64), *block(r, "")))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ahead)], ["query", "ahead"])

    return met.mapInArrow(counted, "query long, ahead long").groupBy("query").agg((F.sum("ahead") + 1).alias("rank"))


def cosines(a: np.ndarray, a_held: np.ndarray, b: np.ndarray, b_held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the cosine, rounded as SQL does it (the sum of products over the product of roots), and whether there is one."""
    (total, some), (aa, _), (bb, _) = exact_dots(a, a_held, b, b_held), exact_dots(a, a_held, a, a_held), exact_dots(b, b_held, b, b_held)
    with np.errstate(all="ignore"):
        return total / (np.sqrt(aa) * np.sqrt(bb)), some


def best_first(score: np.ndarray, some: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order as SQL's ``score desc, item``: NaN above all, pairs without a score last; ``place`` ascends with the item."""
    nan = np.isnan(score)
    return np.lexsort((place, np.where(nan, 0.0, -score), ~nan, ~some))


def top_of_block(q: tuple, i: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair that is among its query's k best in the block: query, item (both by place), score, and whether it has one.

    ``q`` and ``i`` are (vectors, held), items in the order that settles ties. Of equal vectors the first k can be among the best only. A
    matrix product leaves out what its rounding cannot bring among the k best; the rest, and all pairs with odd vectors, are added up.
    """
    (qv, iv), (qh, ih) = same_width(q[0], i[0]), same_width(q[1], i[1])
    whole = np.ascontiguousarray(np.concatenate([iv.view(np.uint8).reshape(len(iv), -1), ih.view(np.uint8).reshape(len(ih), -1)], 1))
    if whole.shape[1]:
        _, kind = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_inverse=True)
    else:
        kind = np.zeros(len(iv), np.int64)
    order = np.argsort(kind, kind="stable")
    first = np.flatnonzero(np.diff(kind[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    left = np.sort(order[nth < k])
    iv, ih = iv[left], ih[left]

    def lengths(v, held):
        with np.errstate(all="ignore"):
            n = np.sqrt((v * v).sum(1))
        return n, held.all(1) & np.isfinite(v).all(1) & (n > 1e-100) & (n < 1e100)

    (qn, q_plain), (i_n, i_plain) = lengths(qv, qh), lengths(iv, ih)
    slack = 16 * (qv.shape[1] + 4) * np.finfo(float).eps
    unit = iv[i_plain] / i_n[i_plain, None]
    odd, plain = np.flatnonzero(~i_plain), np.flatnonzero(i_plain)
    out = [[], [], [], []]

    def settle(x, y):
        """The k best of each query among its pairs (x, y)."""
        parts = [cosines(qv[x[b : b + SLICE // 8]], qh[x[b : b + SLICE // 8]], iv[y[b : b + SLICE // 8]], ih[y[b : b + SLICE // 8]]) for b in range(0, len(x), SLICE // 8)]
        score, some = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        by = best_first(score, some, y)
        by = by[np.argsort(x[by], kind="stable")]
        start = np.flatnonzero(np.diff(x[by], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        by = by[rank < k]
        for to, values in zip(out, (x[by], left[y[by]], score[by], some[by])):
            to.append(values)

    step = max(1, SLICE // max(1, len(iv)))
    for a in range(0, len(qv), step):
        rows = np.arange(a, min(a + step, len(qv)))
        fine = rows[q_plain[rows]]
        xs, ys = [np.repeat(rows[~q_plain[rows]], len(iv)), np.repeat(fine, len(odd))], [np.tile(np.arange(len(iv)), len(rows) - len(fine)), np.tile(odd, len(fine))]
        if len(fine) and len(plain):
            near = (qv[fine] / qn[fine, None]) @ unit.T
            least = np.partition(near, max(0, len(plain) - k), axis=1)[:, max(0, len(plain) - k)] - 2 * slack
            x, y = np.nonzero(near >= least[:, None])
            xs.append(fine[x])
            ys.append(plain[y])
        x, y = np.concatenate(xs), np.concatenate(ys)
        if len(x):
            settle(x, y)
    kinds = (np.int64, np.int64, np.float64, bool)
    return tuple(np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, kinds))


def block_top(queries: DataFrame, items: DataFrame, query: str, item: str, q_vec: str, i_vec: str, k: int) -> DataFrame:
    """(query, item, score, rank): the k items of highest cosine for each query, ties by item, for long ids, without a row a pair.

    Every query is compared with every item, by blocks that are packed into rows. Packed queries are broadcast if they were counted to be
    small, else the two sides are multiplied. Scores are those of SQL: null without a product, NaN, above all, for a vector of zeros.
    """
    n = items.count()
    rows = min(BLOCK, max(LEAST_BLOCK, n // (4 * queries.sparkSession.sparkContext.defaultParallelism) + 1))

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                part = part.take(pa.compute.sort_indices(part.column(0)))  # nulls last
                v, held = vector_matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()]), pa.array([np.packbits(held).tobytes()]), pa.array([len(v)], pa.int64())], ["ids", "vectors", "held", "n"])

    fields = "ids array<long>, vectors binary, held binary, n long"
    pack = lambda df, key, v: with_batches(df.select(F.col(key).cast("long").alias("id"), F.col(v).alias("v")), BATCH_BYTES).mapInArrow(packed, fields)
    q_blocks = cut(pack(queries, query, q_vec), "query-blocks")
    q_blocks = q_blocks.select(*(F.col(c).alias(f"q_{c}") for c in q_blocks.columns))
    i_blocks = cut(pack(items, item, i_vec), "item-blocks").repartition(max(1, -(-n // rows)))
    size = q_blocks.agg(F.coalesce(F.sum("q_n"), F.lit(0)), F.coalesce(F.sum(F.length("q_vectors")), F.lit(0))).first()
    small = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES
    met = i_blocks.crossJoin(F.broadcast(q_blocks)) if small else i_blocks.hint("shuffle_replicate_nl").crossJoin(q_blocks)

    def block(batch, at, s):
        n = batch.column(f"{s}n")[at].as_py()
        v = np.frombuffer(batch.column(f"{s}vectors")[at].as_py()).reshape(n, -1)
        return v, np.unpackbits(np.frombuffer(batch.column(f"{s}held")[at].as_py(), np.uint8), count=v.size).astype(bool).reshape(v.shape)

    def chosen(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                x, y, score, some = top_of_block(block(batch, at, "q_"), block(batch, at, ""), k)
                ids = [batch.column(c)[at].values.take(pa.array(z)) for c, z in (("q_ids", x), ("ids", y))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(score, mask=~some)], ["query", "item", "score"])

    by = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("item"))
    best = met.mapInArrow(chosen, "query long, item long, score double")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def rank_metrics(ranks: DataFrame, at: tuple[int, ...] = (1, 5, 10), rank: str = "rank") -> DataFrame:
    """One row: queries, lower median, mean, mean reciprocal rank, and recall within the first k."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"percentile_disc(0.5) within group (order by `{rank}`)").cast("double").alias("median_rank"),
        F.avg(rank).alias("mean_rank"),
        F.avg(1 / F.col(rank)).alias("mrr"),
        *(F.avg((F.col(rank) <= k).cast("double")).alias(f"recall_at_{k}") for k in at),
    )


def in_batch_loss(scores: DataFrame, batch: str, masked: Column, temperature: float = 1.0, floor: float = -1e6) -> DataFrame:
    """Per batch, the mean cross-entropy of each query against its own item, with ``masked`` pairs set to ``floor``.

    Call it with queries and items exchanged for the other direction and average the two.
    """
    logit = F.when(masked & (F.col("query") != F.col("item")), F.lit(floor)).otherwise(F.col("score") * F.lit(temperature))
    rows = scores.select(batch, "query", "item", logit.alias("z"))
    top = rows.withColumn("m", F.max("z").over(Window.partitionBy(batch, "query")))
    per = top.groupBy(batch, "query").agg((F.max("m") + F.log(F.sum(F.exp(F.col("z") - F.col("m"))))).alias("lse"), F.max(F.when(F.col("query") == F.col("item"), F.col("z"))).alias("own"))
    return per.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("lse") - F.col("own")).alias("loss"))


def symmetric_loss(scores: DataFrame, batch: str, query_key: str, item_key: str, scale: Column | float = 1.0, floor: float = -1e6) -> DataFrame:
    """Per batch, half the loss of queries against items and half that of items against queries.

    ``scores`` has query, item, score, and the ``query_key`` and ``item_key`` of the pair's query and item, each as (own, other): columns
    ``query_key`` and ``query_key_of_item``, and the like. Pairs of items that share their key are masked where queries look for
    items; pairs that share the query's key are masked where items look for queries.
    """
    scaled = scores.withColumn("score", F.col("score") * scale)
    same_item = F.col(item_key) == F.col(f"{item_key}_of_item")
    same_query = F.col(query_key) == F.col(f"{query_key}_of_item")
    one = in_batch_loss(scaled, batch, F.coalesce(same_item, F.lit(False)), floor=floor)
    turned = scaled.select(*(F.col(c) for c in scaled.columns if c not in ("query", "item")), F.col("item").alias("query"), F.col("query").alias("item"))
    other = in_batch_loss(turned, batch, F.coalesce(same_query, F.lit(False)), floor=floor).select(batch, F.col("loss").alias("other"))
    return one.join(other, batch).select(batch, "n", (0.5 * F.col("loss") + 0.5 * F.col("other")).alias("loss"))
