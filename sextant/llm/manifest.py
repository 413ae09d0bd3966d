"""A Merkle manifest of a dataset: one tree for each source, and one over these.

Leaves are numbered within their source. A superblock is so many consecutive
leaves that its nodes fill three levels of the tree. Going up, superblocks are
reduced to one node each, level by level of superblocks, until one node is
left. Going down, the nodes of a superblock and the outer nodes of the path
above it are cogrouped: one call finishes the reduction inside, joins the
proofs and folds them. A source of any size is spread over its superblocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import in_order, positioned
from .common import ascii_lower, new_folder, small_or_shuffled, stage, temporary

#: Nodes of a run, and levels of a superblock of FAN ** DEPTH nodes.
FAN, DEPTH = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path: of each level the siblings before and after the node, as hex.
STEPS = "array<struct<left: string, right: string>>"


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' texts, each after its length in bytes and a colon; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.encode(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), "UTF-8"), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(size: int, depth: int) -> int:
    """Levels until one of ``size`` nodes is left, those of one superblock at most."""
    levels = 0
    while size > 1 and levels < depth:
        size, levels = -(-size // FAN), levels + 1
    return levels


def _reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock, level by level; the last level has one."""
    tiers = [digests]
    for _ in range(levels):
        below = tiers[-1]
        tiers.append([_digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return tiers


def _siblings(tiers: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """Of each level, the other nodes of the run of node ``at``: before and after it."""
    for tier in tiers[:-1]:
        start = at - at % FAN
        yield "".join(tier[start:at]), "".join(tier[at + 1 : start + FAN])
        at //= FAN


def _paths(rows: pd.DataFrame, outer: pd.DataFrame, depth: int) -> Iterator[list[tuple[str, str]]]:
    """Of each row of a superblock, sorted, the path inside it and then above it."""
    tiers = _reduced(rows["digest"].tolist(), _levels(int(rows["size"].iloc[0]), depth))
    above = [(x["left"], x["right"]) for x in outer["steps"].iloc[0]]
    return ([*_siblings(tiers, at), *above] for at in range(len(rows)))


def _superblocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**depth).cast("long"))


def _up(nodes: DataFrame, depth: int) -> DataFrame:
    """``grp, pos, size, digest`` of the superblocks of ``nodes``: one node each."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        (top,) = _reduced(rows["digest"].tolist(), _levels(size, depth))[-1]
        return pd.DataFrame({"grp": rows["grp"].iloc[:1], "pos": rows["block"].iloc[:1], "size": -(-size // FAN**depth), "digest": top})

    return _superblocks(nodes.select("grp", "pos", "size", "digest"), depth).groupBy("grp", "block").applyInPandas(reduce, "grp long, pos long, size long, digest string")


def _down(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """Paths ``grp, pos, steps`` of ``nodes`` from those of their superblocks."""

    def extend(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        steps = [[{"left": a, "right": b} for a, b in path] for path in _paths(rows, outer, depth)]
        return pd.DataFrame({"grp": rows["grp"].to_numpy(), "pos": rows["pos"].to_numpy(), "steps": steps})

    above = above.select("grp", F.col("pos").alias("block"), "steps")
    return _superblocks(nodes, depth).groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInPandas(extend, f"grp long, pos long, steps {STEPS}")


def _proved(leaves: DataFrame, above: DataFrame, root: str, depth: int) -> DataFrame:
    """Each leaf's proof, and the root that its path gives for it as found later."""

    def finish(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        proofs, folded = [], []
        for digest, later, path in zip(rows["digest"], rows["later"], _paths(rows, outer, depth), strict=True):
            proofs.append(_digest("".join(a + b for a, b in path)))
            here = later if isinstance(later, str) else digest
            for a, b in path:
                here = _digest(a + here + b)
            folded.append(here)
        found = {"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": outer["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded}
        return pd.DataFrame(found)

    above = above.select("grp", F.col("pos").alias("block"), "steps", "subroot")
    cogroups = _superblocks(leaves, depth).groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
    return cogroups.applyInPandas(finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def _at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _climb(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes, from ``nodes`` to below the last, and the last: one node for each group."""
    below: list[DataFrame] = []
    while not nodes.where("size > 1").isEmpty():
        below.append(nodes)
        nodes, _ = stage(_up(nodes, depth), "merkle-nodes")
    return below, nodes


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``docs`` has ``doc_id, source, lang, n_chars, text``; other columns, whatever
    their names, are not looked at. A leaf is the digest of these five, nulls
    told from empty texts. The leaves of a source ascend by id (null first; rows
    that repeat an id by their digests), and runs of 16 become nodes until one is
    left, the subroot; the subroots, by source (null first, bytewise), give the
    root in the same way. ``proof_sha256`` digests the siblings on the way, left to
    right, level by level.

    ``tampered`` is the text as it was found later, null for rows not looked at
    again: ``folded_root`` comes from that row's leaf and the stored siblings,
    ``verified`` is whether it is the root. Texts are digested where they are
    read, and never shuffled. A lone leaf is its subroot, a lone subroot the
    root, with an empty proof. A superblock has ``16 ** depth`` nodes, which
    changes no result. An empty table gives an empty result.
    """
    spark, names = docs.sparkSession, [F.col(c) for c in COLUMNS]
    later = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(*names[:-1], tampered))
    nodes_at, paths_at = new_folder(spark, "merkle-leaves"), new_folder(spark, "merkle-paths")  # what the result reads stays
    with temporary(spark):
        leaves, _ = stage(docs.select("doc_id", "source", leaf_digest(*names).alias("digest"), later.alias("later")), "merkle-leaves")
        counts = leaves.groupBy("source").agg(F.count("*").alias("size"))
        numbers, _ = stage(positioned(in_order(counts, ["source"])).select(F.col("source").alias("named"), "size", F.col("_pos").alias("grp")), "merkle-sources")
        numbered = leaves.join(small_or_shuffled(numbers), F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")
        placed = positioned(in_order(numbered, ["grp", "doc_id", "digest", "later"]), ["grp"])
        ids = F.col("doc_id").cast("string").alias("doc_id")  # pandas would make nullable integers doubles
        nodes = _at(placed.select("grp", F.col("_pos").alias("pos"), "size", "digest", ids, "later"), nodes_at)
        inner, subroots = _climb(nodes, depth)
        top, last = _climb(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(subroots.count()).alias("size"), "digest"), depth)
        root = last.first()
        above = last.select("grp", "pos", F.array().cast(STEPS).alias("steps"))
        for tier in reversed(top):
            above, _ = stage(_down(tier, above, depth), "merkle-paths")
        above, _ = stage(above.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "steps"), "merkle-paths")
        for tier in reversed(inner[1:]):
            above, _ = stage(_down(tier, above, depth), "merkle-paths")
        above = _at(above.join(small_or_shuffled(subroots.select("grp", F.col("digest").alias("subroot"))), "grp"), paths_at)
    found = _proved(nodes, above, root["digest"] if root else "", depth)
    return found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as leaves; of every fifth id by crc32, the text is found in lower case later."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, ascii_lower(F.col("text")))
    return merkle_manifest(docs, found)


def _sql(levels: int = 7) -> str:
    """Each tree level by level; ``levels`` of 16 nodes hold all leaves of the small tables."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in (*COLUMNS[:-1], text)) + ")"
    tree = lambda name, nodes, steps: ",\n".join(
        [f"{name}0 AS ({nodes})"]
        + [
            f"""{name}r{i} AS (SELECT grp, pos // 16 AS pos, list(d ORDER BY pos) AS ds, any_value(n) AS n FROM {name}{i} GROUP BY grp, pos // 16),
{name}{i + 1} AS (SELECT grp, pos, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, count(*) OVER (PARTITION BY grp) AS n FROM {name}r{i})"""
            for i in range(steps)
        ]
    )
    step = lambda name, i, at: f"""LEFT JOIN {name}r{i} ON {name}r{i}.grp = {at[0]} AND {name}r{i}.pos = {at[1]} // {16 ** (i + 1)}"""
    before = lambda name, i, at: f"CASE WHEN {name}r{i}.n > 1 THEN array_to_string({name}r{i}.ds[:({at[1]} // {16**i}) % 16], '') ELSE '' END"
    after = lambda name, i, at: f"CASE WHEN {name}r{i}.n > 1 THEN array_to_string({name}r{i}.ds[({at[1]} // {16**i}) % 16 + 2:], '') ELSE '' END"
    inner, outer = ("l.grp", "l.pos"), ("0", "l.grp")
    joins = "\n".join([step("a", i, inner) for i in range(levels)] + [step("b", i, outer) for i in range(levels)])
    sides = [(f"{before(n, i, at)} AS {n}x{i}", f"{after(n, i, at)} AS {n}y{i}", f"{n}r{i}.n > 1 AS {n}m{i}") for n, at in (("a", inner), ("b", outer)) for i in range(levels)]
    names = [f"{n}{{}}{i}" for n in "ab" for i in range(levels)]
    folds = [f"f{k + 1} AS (SELECT *, CASE WHEN {x.format('m')} THEN sha256({x.format('x')} || h{k} || {x.format('y')}) ELSE h{k} END AS h{k + 1} FROM f{k})" for k, x in enumerate(names)]
    return f"""WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
docs AS (
  SELECT doc_id, source, {leaf('text')} AS d,
         CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 0
              THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS later
  FROM documents, crc_table),
l AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d, later NULLS FIRST) - 1 AS pos FROM docs),
{tree('a', 'SELECT grp, pos, d, count(*) OVER (PARTITION BY grp) AS n FROM l', levels)},
{tree('b', f'SELECT 0 AS grp, grp AS pos, d, count(*) OVER () AS n FROM a{levels}', levels)},
f0 AS (SELECT l.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, coalesce(l.later, l.d) AS h0, {', '.join(x for side in sides for x in side)}
FROM l JOIN a{levels} s ON s.grp = l.grp CROSS JOIN b{levels} r
{joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"{x.format('x')} || {x.format('y')}" for x in names)}) AS proof_sha256, h{2 * levels} AS folded_root, h{2 * levels} = root AS verified
FROM f{2 * levels}"""


OP12_SQL = _sql()
