"""Tables in versions: a reader sees the last one that was finished, or the one before.

A table's folder holds ``data/<write>/_part=<part>`` and ``_versions/<number>``, small
manifests that name the folder, digest and count of each part. A write puts
new parts beside the old ones, and then its manifest in place with one rename; nothing
that a manifest of the last versions names is touched. Only parts whose digest differs
from the manifest's are kept, so a change of one day costs that day's part, and
the old rows are not read to find out. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import merge, newest
from ..session import temporary, unstage, written

#: Versions that stay readable after a write.
KEEP = 3


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    target, store = _store(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(target)) if store.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(x) for x in _names(spark, f"{path}/_versions") if x.isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """Schema and parts of a version, the last one by default; None without any."""
    there = versions(spark, path)
    if not there:
        return None
    target, store = _store(spark, f"{path}/_versions/{there[-1] if version is None else version:012d}")
    stream = store.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _rows(spark: SparkSession, path: str, found: dict, parts: Sequence[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(found["schema"])
    folders = [f"{path}/data/{x['folder']}" for name, x in sorted(found["parts"].items()) if parts is None or name in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version. A table never written raises."""
    found = manifest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version of {path}")
    return _rows(spark, path, found)


def digests(df: DataFrame, columns: Sequence[str], part: str = "_part") -> dict[str, list]:
    """Of each part a digest of its rows, whatever their order, and their number: a row a part."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string").alias(f"h{seed}") for seed in (0, 7)]
    return {r[part]: [r["h0"], r["h7"], r["n"]] for r in df.groupBy(part).agg(*sums, F.count("*").alias("n")).collect()}


def _publish(spark: SparkSession, path: str, found: dict, keep: int) -> None:
    """Put the next manifest in place, then delete what only older versions name."""
    there = versions(spark, path)
    number = (there[-1] if there else 0) + 1
    draft, store = _store(spark, f"{path}/_versions/.draft-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(json.dumps(found).encode()))
    finally:
        out.close()
    target, _ = _store(spark, f"{path}/_versions/{number:012d}")
    if not store.rename(draft, target):
        raise OSError(f"version {number} of {path} is there already")
    kept = [number, *there[::-1]][:keep]
    unstage(spark, *(f"{path}/_versions/{v:012d}" for v in there if v not in kept))
    named = {x["folder"].split("/")[0] for v in kept for x in manifest(spark, path, v)["parts"].values()}
    unstage(spark, *(f"{path}/data/{x}" for x in _names(spark, f"{path}/data") if x not in named))


def _part(part: Column | None) -> Column:
    return F.lit("all") if part is None else F.regexp_replace(F.coalesce(part.cast("string"), F.lit("null")), "[^A-Za-z0-9.-]", "-")


def _written_parts(rows: DataFrame, path: str, columns: Sequence[str], before: dict, whole: bool, keep: int) -> set[str]:
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    at = f"{path}/data/{folder}"
    # of a part few files, of a large one several: AQE splits it
    rows.hint("rebalance", "_part").write.option("compression", "zstd").partitionBy("_part").parquet(at)
    there = spark.read.schema(rows.select(*columns, "_part").schema).parquet(at)
    schema = there.select(*columns).schema  # as it is read: everything may be null
    now = digests(there, columns)
    same_shape = before.get("schema") == schema.jsonValue()
    old = before.get("parts", {}) if same_shape or not whole else {}
    changed = {name for name, told in now.items() if name not in old or old[name]["digest"] != told}
    gone = set(old) - set(now) if whole else set()
    unstage(spark, *(f"{at}/_part={name}" for name in now if name not in changed))
    if not changed and not gone and before and same_shape:
        unstage(spark, at)
        return set()
    parts = {name: x for name, x in old.items() if name not in gone} | {name: {"folder": f"{folder}/_part={name}", "digest": now[name]} for name in changed}
    _publish(spark, path, {"schema": schema.jsonValue(), "parts": parts}, keep)
    return changed | gone


def write_snapshot(df: DataFrame, path: str, part: Column | None = None, keep: int = KEEP) -> set[str]:
    """Make ``df`` the table's rows; returns the parts that changed, none if no row did.

    ``df`` is computed once and may read the table itself. ``part`` is a short text,
    such as a year, by which rows are kept together; null has a part of its own."""
    before = manifest(df.sparkSession, path) or {}
    return _written_parts(df.withColumn("_part", _part(part)), path, df.columns, before, True, keep)


def upsert_snapshot(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], part: Column, keep: int = KEEP) -> set[str]:
    """Merge rows into the table: of a key the largest ``order`` stays, the newer row on ties.

    ``part`` must follow from the keys. Only parts with keys of the batch are read or
    written. A repeated batch, or one that ended before its manifest, gives the same table."""
    spark, columns = batch.sparkSession, batch.columns
    with temporary(spark):
        new = written(newest(batch, keys, order).withColumn("_part", _part(part)), "upsert-batch")
        before = manifest(spark, path) or {}
        touched = {r[0] for r in new.select("_part").distinct().collect()}
        if not touched:
            return set()
        old = sorted(touched & set(before.get("parts", {})))
        merged = merge(_rows(spark, path, before, old).select(*columns).withColumn("_part", _part(part)), new, [*keys, "_part"], order) if old else new
        return _written_parts(merged.select(*columns, "_part"), path, columns, before, False, keep)
