"""The Merkle manifest against its SQL and against a tree built leaf by leaf."""

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_sql_operators import check, rows_of

from sextant.llm.manifest import OP12_SQL, merkle_manifest, op12_manifest

LONG = "Long Ä " * 30_000
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
P = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def documents(n, sources=("b", "a", None, "", "ä", "Z"), ids=None):
    texts = [None, "", "Some TEXT", "ä Ö", LONG]
    return pa.table(
        {
            "doc_id": pa.array(ids if ids is not None else range(n), pa.int64()), "source": pa.array([sources[i % len(sources)] if i % 3 else sources[0] for i in range(n)], pa.string()),
            "lang": pa.array([[None, "en", ""][i % 3] for i in range(n)], pa.string()), "n_chars": pa.array([None if i % 7 == 0 else i for i in range(n)], pa.int64()),
            "text": pa.array([texts[i % 5] if i % 5 != 4 or i < 10 else f"T{i}" for i in range(n)], pa.string()), "grp": ["clash"] * n, "pos": [1] * n, "digest": [None] * n, "leaf": [0.5] * n, "size": [1] * n,
        }
    )


@pytest.mark.parametrize(
    "table",
    [documents(0), documents(17, ("a",)), documents(300, (*"bcdefghijklmnopqrs", None, "ä"), [None if i % 50 == 0 else i // 4 for i in range(300)])],
    ids=["empty", "run_and_one", "null_and_repeated_ids"],
)
def test_same_as_sql(spark, tmp_path, table):
    check(spark, tmp_path, op12_manifest, OP12_SQL, documents=table)


@pytest.mark.parametrize("depth", [1])
def test_superblocks_change_no_result(spark, tmp_path, depth):
    pq.write_table(documents(700), f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(merkle_manifest(docs, F.upper("text"), depth)) == rows_of(merkle_manifest(docs, F.upper("text")))


def test_tree_leaf_by_leaf(spark):
    rows = [(i, None if i % 5 == 0 else f"s{i % 2}", "en", 3, f"text {i}") for i in range(400)]
    trees, paths = {}, {}

    def tree(nodes):
        tiers = [nodes]
        while len(tiers[-1]) > 1:
            tiers.append([H(*tiers[-1][i : i + 16]) for i in range(0, len(tiers[-1]), 16)])
        return tiers

    def path(tiers, at):
        found = []
        for tier in tiers[:-1]:
            found += [x for i, x in enumerate(tier) if i // 16 == at // 16 and i != at]
            at //= 16
        return found

    names = [None, "s0", "s1"]
    for s in names:
        trees[s] = tree([H(*map(P, r)) for r in rows if r[1] == s])
    top = tree([trees[s][-1][0] for s in names])
    for s in names:
        for at, r in enumerate(r for r in rows if r[1] == s):
            paths[r[0]] = H(*path(trees[s], at), *path(top, names.index(s)))
    got = merkle_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), F.when(F.col("doc_id") == 7, F.lit("text 8"))).collect()
    assert {r.root for r in got} == {top[-1][0]} and len(got) == 400
    assert all(r.subroot == trees[rows[r.doc_id][1]][-1][0] and r.proof_sha256 == paths[r.doc_id] and r.leaf == H(*map(P, rows[r.doc_id])) for r in got)
    assert [r.doc_id for r in got if not r.verified] == [7]
