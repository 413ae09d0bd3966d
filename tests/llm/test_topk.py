"""Exact top-k search against its SQL and against all products."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_sql_operators import check

from sextant.llm.topk import OP13_SQL, _best, op13_topk, top_k

NAN, INF = float("nan"), float("inf")


def embeddings(vectors, ids=None):
    n = len(vectors)
    clash = {"w": ["x"] * n, "pos": [1] * n, "q": [True] * n, "uid": [5] * n, "rank": [0] * n}
    return pa.table({"vec_id": pa.array(ids if ids is not None else range(n), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), **clash})


def drawn(n, width=6, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, width))
    return (centres[draw.integers(0, 5, n)] + draw.normal(scale=0.1, size=(n, width))).astype("float32").tolist()


@pytest.mark.parametrize(
    "table",
    [
        embeddings([]),
        embeddings([[1.0, 2.0]]),
        embeddings([None, [1.0, None, 0.0, 0, 0, 0], [NAN] * 6, [INF] * 6, [0.0] * 6, *drawn(60), *[[0.5] * 6] * 90, [0.0] * 6]),
        embeddings(drawn(80) * 2, [None if i % 40 == 3 else 20 * (i // 30) for i in range(160)]),
    ],
    ids=["empty", "one", "unusable_and_hot", "null_and_repeated_ids"],
)
def test_same_as_sql(spark, tmp_path, table):
    check(spark, tmp_path, op13_topk, OP13_SQL, embeddings=table)


def test_many_shards_ragged_and_any_query(spark, tmp_path):
    vectors = [v[: 3 + i % 4] for i, v in enumerate(drawn(700))] + [[]]
    pq.write_table(embeddings(vectors), f"{tmp_path}/embeddings.parquet")
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    got = top_k(table, F.col("vec_id") % 7 == 3, k=5, block=8, shard=50).collect()
    w = np.zeros((701, 6), int)
    for i, v in enumerate(vectors):
        w[i, : len(v)] = np.floor(64 * np.array(v, "float32").astype(float))
    want = set()
    for q in range(3, 701, 7):
        scores = w @ w[q]
        best = [d for d in sorted(range(701), key=lambda d: (-scores[d], d)) if d != q][:5]
        want |= {(q, r + 1, d, int(scores[d])) for r, d in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_blocks_are_skipped_and_big_products_exact():
    near, far = np.full((64, 4), 100) + np.arange(64)[:, None], np.full((6400, 4), -5)
    docs = np.concatenate((near, far))
    query, doc, score = _best(np.array([[3, 1, 0, 2]]), np.array([-(2**62)]), docs, np.arange(len(docs)), 3, 64)
    assert doc.tolist() == [63, 62, 61] and score.tolist() == [6 * 163, 6 * 162, 6 * 161]
    big = np.array([[2**28 + 1, 1], [2**28, 1], [2**28 + 1, 1]])
    _, doc, score = _best(big[:1], np.array([0]), big, np.array([9, 8, 7]), 2, 2)
    assert doc.tolist() == [2, 0] and score[0] == (2**28 + 1) ** 2 + 1
    with pytest.raises(OverflowError):
        _best(np.array([[2**40]]), np.array([0]), np.array([[2**40]]), np.array([0]), 1, 1)
