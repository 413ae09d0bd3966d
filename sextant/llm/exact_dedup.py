"""Exact dedup by distributed MSD radix partitioning.

Texts split into groups by their length in bytes and first bytes, then by
ever longer runs of the bytes that follow. A text that is alone in its group
is done; a group whose bytes have ended holds equal texts. Groups are told
apart by the bytes themselves, never by a digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, new_folder, small_or_shuffled, stage, unstage, unused

#: Bytes of the first digit; later digits are wider by GROWTH each, so that
#: the number of rounds grows with the logarithm of the longest text.
FIRST, SECOND, GROWTH = 32, 4096, 16


def normalised(text: Column) -> Column:
    return F.coalesce(ascii_lower(text), F.lit(""))


def _shared(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, str]:
    """Keys that more than one row has, numbered. Counts combine before the shuffle."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return stage(found.withColumn("next", F.monotonically_increasing_id()), name)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null is empty.
    ``keep_id`` is the largest id among equal texts (null ids come last; null
    only if all are), ``kept`` whether the row has it; rows that repeat both
    id and text are kept or dropped together. ``text_sha256`` is output only.
    Texts of any length are compared to their last byte. An empty table gives
    an empty result; other columns are not looked at. Bodies travel only while
    their group is open, and their staged bytes are deleted once split again.
    """
    spark = docs.sparkSession
    body = F.encode(normalised(F.col(text_col)), "UTF-8")
    base = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("len", F.octet_length("body"))
    levels: list[DataFrame] = []

    def split(rows: DataFrame, keys: list[str], width: int, done: int) -> tuple[DataFrame, str]:
        """Divide rows by their next ``width`` bytes. Of the result, rows are alone (no
        group) or ended, and narrow; or open, with the bytes that are left."""
        rest = F.substring("body", F.lit(width + 1), F.lit(2**31 - 1))
        dealt = rows.select("*", F.substring("body", F.lit(1), F.lit(width)).alias("digit"), rest.alias("rest")).drop("body")
        shared, path = _shared(dealt.select(*keys, "digit"), [*keys, "digit"], "radix-keys")
        joined = dealt.join(small_or_shuffled(shared), [*keys, "digit"], "left")
        still = F.col("next").isNotNull() & (F.col("len") > done)
        state = F.when(F.col("next").isNull(), F.lit("alone")).when(still, F.lit("open")).otherwise(F.lit("ended"))
        found = joined.select("doc_id", "sha", "len", F.col("next").alias("grp"), F.when(still, F.col("rest")).alias("body"), F.lit(len(levels)).alias("level"), state.alias("state"))
        at = new_folder(spark, "radix-rows")
        found.write.option("compression", "zstd").partitionBy("state").parquet(at)
        unstage(spark, path)
        levels.append(spark.read.schema(found.schema).parquet(at))
        return levels[-1].where("state = 'open'"), f"{at}/state=open"

    width, done = SECOND, FIRST
    rows, held = split(base.withColumn("sha", F.sha2("body", 256)), ["len"], FIRST, FIRST)
    while not rows.select("len").isEmpty():
        done += width
        rows, following = split(rows, ["grp"], width, done)
        unstage(spark, held)
        held, width = following, width * GROWTH
    columns = ["doc_id", "sha", "grp", "state", "level"]
    settled = reduce(DataFrame.union, [found.where("state <> 'open'").select(*columns) for found in levels])
    ended = settled.where("state = 'ended'")
    groups, _ = stage(ended.groupBy("level", "grp").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "radix-groups")
    members = ended.join(small_or_shuffled(groups), ["level", "grp"]).select("doc_id", "keep_id", "group_size", "sha")
    alone = settled.where("state = 'alone'").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return members.union(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep.

    Rows are addressed by id and normalised text's digest, so a repeated or
    null id drops no other text; the grouping itself needs no digest. Rows
    that repeat id and text stay or go together. All columns stay as they are.
    """
    g_id, g_sha = unused("g_id", docs.columns), unused("g_sha", docs.columns)
    gone = exact_groups(docs).where("NOT kept").select(F.col("doc_id").alias(g_id), F.col("text_sha256").alias(g_sha)).distinct()
    gone, _ = stage(gone, "radix-gone")  # read anew, so that a hot text's rows split in the join below
    address = F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)
    return docs.join(small_or_shuffled(gone), F.col("doc_id").eqNullSafe(F.col(g_id)) & (address == F.col(g_sha)), "left_anti")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of ``documents``, whatever the case of A-Z; null is empty; see ``exact_groups``."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
