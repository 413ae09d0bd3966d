"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_or_shuffled, stage

#: The draw's buckets for each source: prefix sums run over buckets first, and
#: over rows only inside a bucket, so that no source is ordered in one task.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``sizes(source, source_size)`` -> ``+ weight, target``.

    Sources in code point order, null last, weigh ``weights`` in turn. They
    share ``share`` times all sizes by weight; none gets more than ``epochs``
    times its own size, and what is cut is shared again by weight until no
    source is above. With sources ordered by cap over weight, the level at
    which the rest would be shared rises while sources are cut and falls
    after, so its largest value is the final level. One row per source; the
    sources, a table far smaller than the documents, are ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # by_fill runs over the sources only, a table of one row per source
    by_fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return (
        sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size").cast("double") * epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.sum("source_size").over(everything) * share - F.col("full")) / F.col("rest")).over(everything))
        .select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, epochs: int, seed: int, staged: bool) -> DataFrame:
    """``docs`` packed in column ``row``, with ``size, source_size, target, taken, copies``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    rest = [c for c in docs.columns if not (staged and c == "text")]
    # size, source_size and so on may also be columns of the row: packed, they cannot clash
    sized = docs.select(
        (F.struct(*rest) if rest else F.struct(F.lit(0).alias("nothing"))).alias("row"),
        F.col("doc_id").alias("id"),
        F.col("source").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long").alias("draw"),
    )
    if staged:
        sized, _ = stage(sized, "mixing-sizes")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = sized.withColumn("key", key).withColumn("bucket", F.shiftright("draw", 20))
    buckets, _ = stage(sized.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mixing-buckets")
    sizes = buckets.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, epochs).withColumn("key", key)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        buckets.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
        .join(targets.drop("source", "weight"), "key")
        .withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)))
        .withColumn("part", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    )
    plan, _ = stage(plan, "mixing-plan")
    within = Window.partitionBy("key", "bucket").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - used))
    return (
        sized.join(small_or_shuffled(plan), ["key", "bucket"])
        .withColumn("extra", extra)
        .select(
            "row", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
            (F.col("whole") + (F.col("extra") > 0).cast("int")).cast("int").alias("copies"),
        )
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 11) -> DataFrame:
    r"""Add ``size, source_size, target, taken, copies`` to ``docs(doc_id, source, text)``.

    ``size`` is the number of words ``[^\x20\x09-\x0D]+`` of the whole text
    (null text: 0). Every document is taken ``floor(target / source_size)``
    whole times; the fraction left goes to documents in the order of a seeded
    draw on ``doc_id`` and text until the source's target, rounded, is met
    exactly: the last of them is taken in part. ``taken`` counts words, repeats
    included, and never exceeds ``epochs * size``; ``copies`` is how often a
    document is taken whole or in part. The text itself is dropped. Reruns
    agree: the draw depends only on seed, id and text; equal draws are ordered
    by id and size. Null and repeated ids are rows like any other and spread by
    their texts; only rows that repeat both share one bucket. Sources of size 0
    have target 0. An empty table gives an empty result. Columns called like
    the added ones are replaced, any others stay.
    """
    added = ("size", "source_size", "target", "taken", "copies")
    rest = [c for c in docs.columns if c not in (*added, "text")]
    found = _mixed(docs, weights, share, epochs, seed, staged=True)
    return found.select(*(F.col("row")[c].alias(c) for c in rest), *added)


def repeat_mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 11) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it, whole or in part.

    Repeats of a document are whole, so a source exceeds its target by less
    than one document. Each row is counted and repeated by itself, repeated
    rows too. All columns stay as they are, whatever their names.
    """
    found = _mixed(docs, weights, share, epochs, seed, staged=False).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("n")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each row of ``documents`` the mix of sources takes; null texts have none,
    a null source is one of its own; see ``mix``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight,
             source_size::DOUBLE * 2 AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM f),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, round(p.target)::BIGINT - p.whole * p.source_size AS part,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, part - used)))::BIGINT AS taken FROM c
"""
