"""Exact top-k inner products by block-at-a-time pruning.

A vector of integer weights is a document whose terms are the components. In
an order that puts like vectors together, ranges of documents are blocks, and
a shard is so many blocks that a task holds their forward indexes. A block keeps
the largest and smallest weight of each term; the sum of a query's weights
times these bounds every score in the block. A query takes the blocks of a shard
by falling bound and scores them through their forward index until the bound
is below its k-th score. It starts in its own shard, whose k-th score decides
which other shards can hold anything for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import in_order, positioned
from .common import new_folder, small_or_shuffled, stage, temporary

#: Vectors of a block and of a shard; shards whose queries travel together; shards whose bounds do.
BLOCK, SHARD, BATCH, CHUNK = 128, 4096, 16, 4096
#: Vectors that order all others: each lies with the one it is most like. They change no result.
PIVOTS = 64
_LOWEST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def weights(vec: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of every component; null where a vector or component is null or not finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vec, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of weights; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    found = np.zeros((len(sizes), width), np.int64)
    found[np.arange(width) < sizes[:, None]] = flat
    return found


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T``: by doubles while they hold all sums, else by integers."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query scores at most in each block, from the blocks' term maxima and minima."""
    return _products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low)


def _best(queries: np.ndarray, least: np.ndarray, docs: np.ndarray, ties: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` best documents with at least its ``least`` score:
    numbers of queries and documents, and scores. Equal scores go by ``ties``."""
    if not len(queries) or not len(docs):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    queries, docs = _alike(queries, docs)
    starts = np.arange(0, len(docs), block)
    bounds = _bounds(queries, np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts))
    order = np.argsort(~bounds, axis=1, kind="stable")
    score = np.full((len(queries), k), _LOWEST)
    tie, doc = np.full(score.shape, _LAST), np.full(score.shape, -1)
    bar, live = least.copy(), np.arange(len(queries))
    for step in range(len(starts)):
        live = live[bounds[live, order[live, step]] >= bar[live]]
        if not len(live):
            break
        here = order[live, step]
        for b in np.unique(here):
            rows, part = live[here == b], slice(starts[b], starts[b] + block)
            found = _products(queries[rows], docs[part])
            some = (found >= bar[rows][:, None]).any(axis=1)
            rows, found = rows[some], found[some]
            if not len(rows):
                continue
            found[found < bar[rows][:, None]] = _LOWEST
            both = np.concatenate((score[rows], found), axis=1)
            names = np.concatenate((tie[rows], np.broadcast_to(ties[part], found.shape)), axis=1)
            numbers = np.concatenate((doc[rows], np.broadcast_to(np.arange(len(docs))[part], found.shape)), axis=1)
            first = np.lexsort((names, ~both), axis=-1)[:, :k]
            score[rows], tie[rows], doc[rows] = (np.take_along_axis(x, first, axis=1) for x in (both, names, numbers))
            bar[rows] = np.maximum(bar[rows], score[rows, k - 1])
    query, place = np.nonzero(score > _LOWEST)
    return query, doc[query, place], score[query, place]


def _hits(queries: pa.Table, docs: pa.Table, least: np.ndarray, k: int, block: int) -> pa.Table:
    ties = docs["vec_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
    query, doc, score = _best(_matrix(queries["w"]), least, _matrix(docs["w"]), ties, k, block)
    return pa.table({"pos": queries["pos"].take(pa.array(query)), "uid": docs["uid"].take(pa.array(doc)), "vec_id": docs["vec_id"].take(pa.array(doc)), "score": score})


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the ``k`` rows that ties prefer: no others can be among
    any query's ``k``. One of them stands for the queries with this vector."""
    by = Window.partitionBy("w").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    copies = rows.withColumn("copy", F.row_number().over(by)).where(F.col("copy") <= k)
    asked = rows.where("q").select("w").distinct().withColumn("asked", F.lit(True))
    return copies.join(asked, "w", "left").select("uid", "vec_id", "w", (F.col("asked").isNotNull() & (F.col("copy") == 1)).alias("q"))


def _placed(rows: DataFrame, shard: int) -> DataFrame:
    """``rows`` with ``pos`` and ``shard`` in an order that puts like vectors together:
    by the pivot that a vector is most like, and how like it is."""
    code = F.xxhash64("w")
    drawn = rows.groupBy(F.pmod(code, F.lit(PIVOTS)).alias("p")).agg(F.min_by("w", code).alias("w")).toArrow()  # at most PIVOTS rows
    pivots = _matrix(drawn["w"]).astype(np.float64)
    pivots /= np.maximum(1e-300, np.sqrt((pivots * pivots).sum(axis=1, keepdims=True)))

    def place(batches):
        for batch in batches:
            w, among = _alike(_matrix(batch.column("w")), pivots)
            near = w.astype(np.float64) @ among.T
            own = near.argmax(axis=1) if len(among) else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(own, pa.int64())).append_column("near", pa.array(near[np.arange(len(own)), own], pa.float64()))

    near = rows.mapInArrow(place, "uid long, vec_id long, w array<long>, q boolean, cell long, near double")
    placed = positioned(in_order(near, ["cell", "near", "vec_id", "uid"]))
    return placed.select("uid", "vec_id", "w", "q", F.col("_pos").alias("pos"), F.floor(F.col("_pos") / shard).cast("long").alias("shard"))


HIT = "pos long, uid long, vec_id long, score long"


def _own_shards(docs: DataFrame, k: int, block: int) -> DataFrame:
    """The best of each query's own shard; and for each shard, at ``pos`` -1 - shard,
    the largest and smallest weight of each term."""

    def own(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        w, queries, lists = _matrix(group["w"]), group.filter(group["q"]), pa.list_(pa.int64())
        found = _hits(queries, group, np.full(len(queries), _LOWEST), k, block)
        number, nothing = pa.array([-1 - group["shard"][0].as_py()], pa.int64()), pa.nulls(1, pa.int64())
        edges = pa.table({"pos": number, "uid": nothing, "vec_id": nothing, "score": nothing, "high": pa.array([w.max(axis=0)], lists), "low": pa.array([w.min(axis=0)], lists)})
        empty = pa.nulls(len(found), lists)
        return pa.concat_tables([found.append_column("high", empty).append_column("low", empty), edges])

    return docs.groupBy("shard").applyInArrow(own, f"{HIT}, high array<long>, low array<long>")


def _wanted(queries: DataFrame, edges: DataFrame, shards: int) -> DataFrame:
    """``batch, shard``: where a query of the batch may score as much as its bar, its own shard aside."""

    def reach(key: tuple, asked: pa.Table, there: pa.Table) -> pa.Table:
        if not len(asked) or not len(there):
            return pa.table({"batch": pa.array([], pa.int64()), "shard": pa.array([], pa.int64())})
        asked_w, high = _alike(_matrix(asked["w"]), _matrix(there["high"]))
        bounds = _bounds(asked_w, high, _alike(asked_w, _matrix(there["low"]))[1])
        wanted = (bounds >= asked["bar"].to_numpy()[:, None]) & (asked["shard"].to_numpy()[:, None] != there["shard"].to_numpy()[None, :])
        found = there["shard"].filter(pa.array(wanted.any(axis=0)))
        return pa.table({"batch": pa.array([key[0].as_py()] * len(found), pa.int64()), "shard": found})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1) // n)).cast("array<long>"))
    asked = queries.select("batch", every(CHUNK).alias("chunk"), "shard", "w", "bar").groupBy("batch", "chunk")
    there = edges.select(every(BATCH).alias("batch"), F.floor(F.col("shard") / CHUNK).cast("long").alias("chunk"), "shard", "high", "low").groupBy("batch", "chunk")
    return asked.cogroup(there).applyInArrow(reach, "batch long, shard long")


def _other_shards(queries: DataFrame, docs: DataFrame, wanted: DataFrame, k: int, block: int) -> DataFrame:
    """What queries find in the shards that their batch wants."""

    def score(asked: pa.Table, there: pa.Table) -> pa.Table:
        other = asked.filter(pa.array(asked["home"].to_numpy() != asked["shard"].to_numpy()))
        return _hits(other, there.sort_by("pos"), other["bar"].to_numpy(), k, block)

    asked = queries.withColumnRenamed("shard", "home").join(small_or_shuffled(wanted), "batch").groupBy("batch", "shard")
    there = docs.select("shard", "pos", "uid", "vec_id", "w").join(small_or_shuffled(wanted), "shard").groupBy("batch", "shard")
    return asked.cogroup(there).applyInArrow(score, HIT)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row the ``k`` rows, itself left out, with the largest inner products.

    Products are of ``weights``, exact integers; equal scores go by the smaller id,
    null ids last. ``rank`` counts from 1; a query has fewer rows only if the table
    has. Vectors that are null or hold null or non-finite components take no part;
    zero and empty vectors do; a shorter vector has zeros at its end. Rows that repeat
    an id are rows of their own, each a candidate of the other. Equal vectors are
    searched for once, and of their rows the k + 1 that ties prefer are searched. Ids
    are integers. A score that may need more than 64 bits raises. Other columns,
    whatever their names, are not looked at. An empty table, or one without queries,
    gives an empty result.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("q"), weights(F.col(vec_col), scale).alias("w")).where("w IS NOT NULL")
    rows, _ = stage(usable.select(F.monotonically_increasing_id().alias("uid"), "*"), "topk-rows")
    answers_at = new_folder(spark, "topk-answers")
    with temporary(spark):
        docs, _ = stage(_placed(_candidates(rows, k + 1), shard), "topk-docs")
        first, _ = stage(_own_shards(docs, k + 1, block), "topk-first")
        edges = first.where("pos < 0").select((-1 - F.col("pos")).alias("shard"), "high", "low")
        hits = first.where("pos >= 0").select("pos", "uid", "vec_id", "score")
        bars, _ = stage(hits.groupBy("pos").agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(F.col("n") > k).select("pos", "bar"), "topk-bars")
        queries = docs.where("q").join(small_or_shuffled(bars), "pos", "left").withColumn("batch", F.floor(F.col("shard") / BATCH).cast("long"))
        queries, _ = stage(queries.select("batch", "shard", "pos", "w", F.coalesce("bar", F.lit(_LOWEST)).alias("bar")), "topk-queries")
        wanted, _ = stage(_wanted(queries, edges, edges.count()), "topk-wanted")
        more, _ = stage(_other_shards(queries, docs, wanted, k + 1, block), "topk-more")
        by = Window.partitionBy("pos").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        best = hits.union(more).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)
        best = best.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("rank", "uid", "vec_id", "score"))).alias("found"))  # k + 1 at most
        best.join(queries.select("pos", "w"), "pos").select("w", "found").write.option("compression", "zstd").parquet(answers_at)
    answers = spark.read.schema("w array<long>, found array<struct<rank: int, uid: long, vec_id: long, score: long>>").parquet(answers_at)
    asked = rows.where("q").select("uid", F.col("vec_id").alias("query_id"), "w").join(answers, "w")
    others = F.slice(F.filter("found", lambda x: x["uid"] != F.col("uid")), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector of ``embeddings`` by id against all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: Brute force, in doubles, which hold these products exactly.
OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, d.vec_id, CASE WHEN len(q.w) = 0 THEN 0 ELSE list_inner_product(q.w, d.w) END::BIGINT AS score
      FROM v q JOIN v d ON q.n <> d.n WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
