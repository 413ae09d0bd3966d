"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, new_folder, shared_root, small_or_shuffled, temporary, unstage

__all__ = ["BROADCAST_BYTES", "ascii_lower", "components", "new_folder", "shared_root", "small_or_shuffled", "stage", "temporary", "unstage", "unused"]


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and survives the loss of any executor. Returns the table and its path."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def unused(name: str, *columns: Iterable[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for part in columns for c in part}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    every step is a grouped minimum and a join, each round is staged. Returns
    ``node, component`` (smallest node reachable) for nodes with an edge to
    another node. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, path = stage(pairs.distinct(), "links")
    while True:
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following, next_path = stage(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        unstage(spark, path)
        current, path = following, next_path
        twice = current.groupBy("a").count().where("count > 1").select("a")
        chained = current.join(current.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if twice.union(chained).isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
