"""Tables in versions: readers are never disturbed, whatever a writer does or where it stops."""

import threading

import pytest
from pyspark.sql import functions as F

from sextant.sources import snapshots
from sextant.sources.snapshots import manifest, read_snapshot, upsert_snapshot, versions, write_snapshot


def rows(spark, *x):
    return spark.createDataFrame(list(x), "k int, t int, v string")


def found(spark, path, version=None):
    return {r.k: r.v for r in read_snapshot(spark, path, version).collect()}


def test_a_reader_in_a_loop_never_fails(spark, tmp_path):
    path, failed, seen, done = str(tmp_path / "t"), [], set(), threading.Event()
    write_snapshot(rows(spark, (1, 0, "0"), (2, 0, "0")), path)

    def read():
        while not done.is_set():
            try:
                got = found(spark, path)
                seen.add(got[1])
                if set(got) != {1, 2} or got[1] != got[2]:
                    failed.append(got)
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 21):
        assert write_snapshot(rows(spark, (1, i, str(i)), (2, i, str(i))), path) == {"all"}
    done.set()
    reader.join()
    assert not failed and len(seen) > 3 and len(versions(spark, path)) == 3
    assert len(list((tmp_path / "t/data").iterdir())) == 3


@pytest.mark.parametrize("step", ["digests", "_publish", "after"])
def test_a_writer_may_stop_anywhere(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    write_snapshot(rows(spark, (1, 0, "old")), path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "after":  # the manifest is in place, what only old ones name is not yet gone
            m.setattr(snapshots, "unstage", lambda _, *paths: stop() if any("_versions" in x for x in paths) else None)
        else:
            m.setattr(snapshots, step, stop)
        with pytest.raises(KeyboardInterrupt):
            write_snapshot(rows(spark, (1, 1, "new")), path, keep=1)
    assert found(spark, path) == {1: "new" if step == "after" else "old"}
    write_snapshot(rows(spark, (1, 2, "next")), path)
    assert found(spark, path) == {1: "next"}
    named = {x["folder"].split("/")[0] for v in versions(spark, path) for x in manifest(spark, path, v)["parts"].values()}
    assert {x.name for x in (tmp_path / "t/data").iterdir()} == named  # what was left halfway is gone


def test_unchanged_rows_write_no_version_and_one_day_one_part(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(400).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("t"), F.lit("x").alias("v"))
    part = F.floor(F.col("k") / 20)
    assert len(write_snapshot(table, path, part)) == 20
    assert write_snapshot(table.repartition(3).orderBy(F.desc("k")), path, part) == set() and len(versions(spark, path)) == 1
    before = manifest(spark, path)["parts"]
    assert write_snapshot(read_snapshot(spark, path).withColumn("v", F.when(F.col("k") == 47, "y").otherwise(F.col("v"))), path, part) == {"2"}
    after = manifest(spark, path)["parts"]
    assert [x for x in after if after[x]["folder"] != before[x]["folder"]] == ["2"] and found(spark, path)[47] == "y" and found(spark, path, 1)[47] == "x"
    assert write_snapshot(read_snapshot(spark, path).where("k >= 20"), path, part) == {"0"} and len(found(spark, path)) == 380


def test_upsert_reads_and_writes_touched_parts_only(spark, tmp_path):
    path, part = str(tmp_path / "t"), F.floor(F.col("k") / 10)
    upsert_snapshot(rows(spark, *((k, 1, "a") for k in range(40))), path, ["k"], ["t"], part)
    for x in (tmp_path / "t").glob("data/*/_part=[013]/*.parquet"):
        x.unlink()  # reading them would fail
    assert upsert_snapshot(rows(spark, (25, 2, "b"), (26, 0, "late")), path, ["k"], ["t"], part) == {"2"}
    assert upsert_snapshot(rows(spark, (25, 2, "b")), path, ["k"], ["t"], part) == set()
    assert upsert_snapshot(rows(spark), path, ["k"], ["t"], part) == set()


def test_empty_tables_null_parts_and_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path)
    assert write_snapshot(rows(spark), path) == set() and found(spark, path) == {} and len(versions(spark, path)) == 1
    assert write_snapshot(rows(spark, (None, 1, "a/b"), (1, 1, "a=b")), path, F.col("v")) == {"a-b"} and len(found(spark, path)) == 2
    assert write_snapshot(rows(spark, (None, 1, None)), path, F.col("v")) == {"a-b", "null"}
    assert write_snapshot(rows(spark, (None, 1, None)).withColumn("more", F.lit(1)), path, F.col("v")) == {"null"}
    assert read_snapshot(spark, path).columns == ["k", "t", "v", "more"]
