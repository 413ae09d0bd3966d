"""Operators that SQL expresses, against their SQL on small tables of odd rows."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sextant.llm.exact_dedup import OP10_SQL, drop_copies, op10_exact_dedup
from sextant.llm.mixing import OP9_SQL, mix, op9_mixing, repeat_mixed
from sextant.llm.url_filter import OP1_SQL, RULE_SCHEMA, filter_urls, op1_url_filters
from sextant.llm.vector_join import OP4_SQL, link_vectors, op4_vector_join
from sextant.llm.warc import OP8_SQL, assemble, op8_warc, read_warc, write_warc

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/b?c#d",
    "https://example.com/en", "https://example.com/EN/", "https://x.net/es/", "https://x.net/es/?q", "http://net/fr/a/b/c", "http://internet/es/", "http://a.com?x=/y", "http://a.com#z",
    "x://b://c.com/", "http://example.com//en/", "http://user@net:80/es/", "http://.com/", "http://a.com./", "\nhttp://a.com/b\nc", "http://ÄX.com/é", "http://a.com/" + "b/" * 3000,
]
LONG = "Long " * 30_000
TEXTS = [None, "", " ", "a", "A", "a b", "A B", "Ä", "ä", LONG, LONG.lower(), LONG + "x", LONG + "y", LONG, "tail\nx", "tail\tx", "a" * 40, "a" * 41, "A" * 40, "a" * 39 + "b"]


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def check(spark, folder, query, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    columns, got = rows_of(query(spark, str(folder)))
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    return got


def pages(urls):
    return pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(["x"] * len(urls)), "host": ["clash"] * len(urls), "rule": [7] * len(urls)})


def documents(texts, sources=None, ids=None):
    n = len(texts)
    return pa.table({"doc_id": pa.array(ids or list(range(n)), pa.int64()), "text": pa.array(texts, pa.string()), "source": pa.array(sources or [None] * n, pa.string()), "size": ["clash"] * n, "body": [None] * n, "len": [0] * n})


@pytest.mark.parametrize("urls", [URLS, URLS * 2, []])
def test_url_filters(spark, tmp_path, urls):
    check(spark, tmp_path, op1_url_filters, OP1_SQL, pages=pages(urls))


def test_url_rules_tie_repeat_and_lack_parts(spark):
    seen = spark.createDataFrame([(1, "http://a.b.com/x/y"), (2, None), (3, "http://b.com/x")], "page_id long, url string")
    rules = [("b.com", "/x", "allow"), ("b.com", "/x", "block"), ("b.com", "/x", "block"), (None, "/", "block"), ("com", None, "block")]
    got = filter_urls(seen, spark.createDataFrame(rules, RULE_SCHEMA)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("b.com/x", "block"), (None, "allow"), ("b.com/x", "block")]
    none = filter_urls(seen, spark.createDataFrame([], RULE_SCHEMA), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}


@pytest.mark.parametrize("texts", [TEXTS, TEXTS + TEXTS[::-1], []])
def test_exact_dedup(spark, tmp_path, texts):
    check(spark, tmp_path, op10_exact_dedup, OP10_SQL, documents=documents(texts))


def test_exact_dedup_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "A"), (1, "b"), (1, "B"), (1, "c"), (2, "c")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in drop_copies(docs).collect()), key=repr)
    assert kept == sorted([(None, "a"), (None, "A"), (1, "b"), (1, "B"), (2, "c")], key=repr)


@pytest.mark.parametrize(
    ("texts", "sources"),
    [
        (["w " * (i * 7 % 23) for i in range(200)], ["hot" if i % 3 else ["a", "b", None, "", "é"][i % 5] for i in range(200)]),
        ([None, "", "x"], ["a", "b", None]),
        ([None], ["a"]),
        ([LONG, "x"], ["a", "b"]),
        ([], []),
    ],
)
def test_mixing(spark, tmp_path, texts, sources):
    got = check(spark, tmp_path, op9_mixing, OP9_SQL, documents=documents(texts, sources))
    columns = ["doc_id", "size", "source_size", "taken", "target"]
    for r in (dict(zip(columns, g, strict=True)) for g in got):
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]


def test_mixing_fills_every_target_and_repeats_rows(spark):
    rows = [(i, ["a", "b", None][i % 3] if i % 4 else "a", "w " * (1 + i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mix(docs).collect()
    for source in ("a", "b", None):
        mine = [r for r in plan if r.source == source]
        assert sum(r.taken for r in mine) == round(mine[0].target)
    assert sum(r.target for r in {r.source: r for r in plan}.values()) == pytest.approx(1.5 * sum(r.size for r in plan))
    copies = {r.doc_id: r.copies for r in plan}
    again = [r.doc_id for r in repeat_mixed(docs).collect()]
    assert {d: again.count(d) for d in copies} == copies


def vectors(rows):
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()), "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float32())), "grp": [0] * len(rows)})


def test_vector_join(spark, tmp_path):
    near = [[math.cos(a), math.sin(a), 0.1 * (a > 1)] for a in (i * 0.13 for i in range(40))]
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0]]
    rows = [(i * 3 % 97, i % 2 if i % 7 else None, v) for i, v in enumerate(near + odd + near[:9])]
    check(spark, tmp_path, op4_vector_join, OP4_SQL, embeddings=vectors(rows))
    check(spark, tmp_path, op4_vector_join, OP4_SQL, embeddings=vectors([]))


@pytest.mark.parametrize(("block", "noise"), [(16, 0.25), (40, 0.25), (24, 0.02), (24, 0.6)])
def test_cells_and_blocks_lose_no_link(spark, monkeypatch, block, noise):
    """Small cells and blocks, so that levels of pivots, balls, copies to other cells and blocks all matter."""
    import numpy as np

    from sextant.llm import vector_join

    monkeypatch.setattr(vector_join, "BLOCK", block)
    monkeypatch.setattr(vector_join, "TILE", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    data = np.repeat(centres, 25, axis=0) + rng.normal(size=(300, 6)) * noise
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(data)], "vec_id long, label int, embedding array<double>")
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    links = (units @ units.T >= 0.93) & ~np.eye(300, dtype=bool)
    least = np.arange(300)
    for _ in range(300):
        least = np.minimum(least, np.where(links, least[None, :], 300).min(axis=1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(frame).collect()}
    assert got == {i: (int(links[i].sum()), int(least[i])) for i in range(300)}


def test_vectors_without_id_and_with_clashing_columns(spark):
    rows = [(None, 1, [1.0, 0.0]), (5, 1, [1.0, 0.01]), (5, 1, [1.0, 0.01]), (None, 2, [1.0, 0.0]), (7, None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS pid", "2 AS cell", "3 AS h1", "4 AS links")
    got = sorted((tuple(r) for r in link_vectors(frame).collect()), key=repr)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True), (7, 0, 7, True)], key=repr)


def test_warc(spark, tmp_path):
    bodies = [None, "", "x", "y" * 999, "y" * 999, "z" * 1000, "z" * 1000, "z" * 1000, "é" * 500, "é" * 500, "WARC/1.1\r\n\r\n" * 200, "\r\n" * 600, "q" * 3_000_000]
    table = pa.table({"page_id": pa.array(range(len(bodies)), pa.int64()), "url": pa.array(["http://a/ b\n", None] * 6 + ["x"]), "html": pa.array(bodies, pa.string()), "row": [1] * len(bodies)})
    check(spark, tmp_path, op8_warc, OP8_SQL, pages=table)
    check(spark, tmp_path, op8_warc, OP8_SQL, pages=table.slice(0, 0))


def test_warc_captures_hold_payload_request_and_metadata(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "é" * 800), (2, "http://b/", "é" * 800), (3, None, None), (None, "u", "v")], "page_id long, url string, html string")
    manifest = write_warc(pages, f"file://{tmp_path}/w")
    assert manifest.selectExpr("sum(records)").first()[0] == 12
    found = {r.metadata["fields"].get("page_id") if r.metadata["fields"] else None: r for r in assemble(read_warc(spark, f"file://{tmp_path}/w")).collect()}
    assert found["2"].payload.decode() == "é" * 800 and found["1"].payload is None and found["1"].refers_to == found["2"].capture_id
    assert all(r.parts == 2 and r.request.record_id for r in found.values()) and found["3"].target_uri is None and found[None].payload == b"v"


def test_warc_reads_only_what_finished_attempts_wrote(spark, tmp_path, monkeypatch):
    """A task that fails after its first archive runs again: each page counts once."""
    from sextant.llm import warc

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"{i} " * 300) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = write_warc(pages, f"file://{tmp_path}/w")
    first = manifest.orderBy("archive").first().archive
    assert manifest.count() > 1 and manifest.selectExpr("sum(records)").first()[0] == 120
    whole = (tmp_path / "w" / first).read_bytes()
    partition, attempt, number = first.removesuffix(".warc.gz").removeprefix("part-").split("-")
    (tmp_path / "w" / f"part-{partition}-{int(attempt) + 1000}-{number}.warc.gz").write_bytes(whole)  # left by an attempt before
    (tmp_path / "w" / f"part-{partition}-{int(attempt) + 1001}-{number}.warc.gz").write_bytes(whole[:40])
    assert read_warc(spark, f"file://{tmp_path}/w").where("type = 'damaged'").count() == 1
    records = read_warc(spark, f"file://{tmp_path}/w", manifest=manifest)
    assert records.count() == 120
    assert sorted(int(r.metadata["fields"]["page_id"]) for r in assemble(records).collect()) == list(range(40))


def test_warc_of_repeated_ids(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://a/", "é" * 800)] * 5 + [(3, "http://b/", "é" * 800)], "page_id long, url string, html string").withColumn("row", F.lit("x")).withColumn("sha", F.lit(1))
    captures = assemble(read_warc(spark, f"file://{tmp_path}/w", manifest=write_warc(pages, f"file://{tmp_path}/w"))).collect()
    response = [r for r in captures if r.type == "response"]
    assert len(captures) == 6 and len(response) == 1 and response[0].metadata["fields"]["page_id"] == "7"
    assert {r.refers_to for r in captures if r.type == "revisit"} == {response[0].capture_id}


def test_foreign_and_damaged_archives(spark, tmp_path):
    record = lambda headers, block: ("\r\n".join(["WARC/1.0", *headers, "", ""])).encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nbody"
    good = record(["WARC-Type: response", "WARC-Record-ID: <a>", "WARC-Payload-Digest: sha1:" + "1" * 32, f"Content-Length: {len(http)}"], http)
    revisit = record(["WARC-Type: revisit", "WARC-Record-ID: <b>", "WARC-Payload-Digest: sha1:" + "0" * 32, f"Content-Length: {len(http)}"], http)
    lost = record(["WARC-Type: response", "WARC-Record-ID: <c>", "Content-Length: ten"], b"")
    (tmp_path / "plain.warc").write_bytes(good + lost + revisit)
    (tmp_path / "cut.warc").write_bytes(good + revisit[:-20])
    (tmp_path / "torn.warc.gz").write_bytes(__import__("gzip").compress(good + revisit)[:-30])
    (tmp_path / "odd.warc").write_bytes(b"\x1f\x8bnothing")
    (tmp_path / "empty.warc").write_bytes(b"")
    found = {}
    for r in read_warc(spark, f"file://{tmp_path}").collect():
        found.setdefault(r.archive, []).append((r.type, r.record_id))
    assert found["plain.warc"] == [("response", "<a>"), ("damaged", None), ("revisit", "<b>")]
    assert found["cut.warc"] == [("response", "<a>"), ("damaged", None)] and found["odd.warc"] == [("damaged", None)]
    assert found["torn.warc.gz"][-1] == ("damaged", None) and "empty.warc" not in found
    assert assemble(read_warc(spark, f"file://{tmp_path}")).count() > 0


def test_mixing_spreads_null_ids_and_counts_every_repeated_row(spark):
    rows = [(None, "a", f"w {i}") for i in range(200)] + [(1, "a", "x y z")] * 30 + [(2, "b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for c in ("p_id", "copies", "_n", "draw", "bucket", "row", "size"):  # names that the operator might use itself
        docs = docs.withColumn(c, F.lit(c))
    plan = mix(docs)
    assert "draw" in plan.columns and len({r.draw for r in plan.collect()}) == 1
    got = plan.collect()
    for source in ("a", "b"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
    again = repeat_mixed(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)
    assert again.where("doc_id = 1").count() == sum(r.copies for r in got if r.doc_id == 1)


def test_url_columns_that_clash_and_empty_host_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", 5, 6), (2, None, 5, 6), (3, "x", 5, 6)], "page_id long, url string, d_host int, d_path int")
    rules = spark.createDataFrame([("", "", "block"), ("com", "/", "allow")], RULE_SCHEMA)
    got = filter_urls(pages, rules)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert {(r.page_id, r.d_host, r.rule, r.verdict) for r in got.collect()} == {(1, 5, "com/", "allow"), (2, 5, "", "block"), (3, 5, "", "block")}


def test_exact_dedup_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "A", 1, 2, 3)], "doc_id long, text string, g_id int, body int, state int")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "A", 1, 2, 3)]


def test_larger_tables_are_shuffled_not_broadcast(spark):
    from sextant.llm.common import small_or_shuffled

    df = spark.range(1000).withColumn("s", F.lit("x" * 100))
    hinted = lambda limit: "broadcast" in small_or_shuffled(df, limit)._jdf.queryExecution().logical().toString().lower()
    assert hinted(1000 * 132) and not hinted(1000 * 132 - 1)
