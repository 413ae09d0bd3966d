"""Embedding near-duplicates: an exact metric range join with pivots.

On unit vectors a cosine bound is a bound on distance. Cells that are too large
for one task are divided by pivots, level by level: each vector goes to the cell
of its nearest pivot, and is copied to every other cell that may hold a partner
within the radius. By the triangle inequality, all vectors within half the radius
of a pivot are linked with each other: these are counted without a comparison.
Cells join independently; those that pivots do not divide well, in blocks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, small_or_shuffled, stage, unstage

#: Vectors of each side that a task compares at once, and rows of a tile of these.
BLOCK, TILE = 8192, 1024
#: Pivots that a cell is divided by at most, whatever its size.
FANOUT = 64
#: What rounding may add to a distance.
MARGIN = 1e-7


def _usable(vec: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _units(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    found = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    found /= np.abs(found).max(axis=1, keepdims=True)  # keeps squares in range
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def _apart(units: np.ndarray, radius: float, most: int) -> np.ndarray:
    """Greedy: rows more than ``radius`` from all taken before, at most ``most``."""
    taken = [units[0]]
    for row in units[1:]:
        if len(taken) < most and (2 - 2 * (np.array(taken) @ row)).min() > radius * radius:
            taken.append(row)
    return np.array(taken)


def _divided(cells: DataFrame, large: DataFrame, radius: float) -> tuple[DataFrame, list[str]]:
    """The rows of ``large`` cells in the cells of their pivots.

    A row whose nearest pivot is p is needed in the cell of q if a row nearer
    to q may be within ``radius``: only if the plane between p and q is. Pivots
    are rows of the cell by a seeded draw, more than ``radius`` apart. Each task
    takes a part of one cell with the cell's few pivots. Staged: the table and all paths."""
    schema, columns = T.StructType([T.StructField("parent", T.StringType()), *cells.schema]), cells.columns

    def assign(part: pa.Table, drawn: pa.Table) -> pa.Table:
        if not part.num_rows or not drawn.num_rows:  # no pivots by chance: the cell stays as it is, and gains nothing
            names = part["cell"].to_pylist()
            return part.select(columns).set_column(0, "cell", pa.array([f"{x}.0" for x in names], pa.string())).add_column(0, "parent", pa.array(names, pa.string()))
        units, copies = _units(part["vec"]), part.select(columns)
        among = _apart(_units(drawn.sort_by("pid")["vec"]), radius, drawn["pivots"][0].as_py())
        squares = np.maximum(0, 2 - 2 * units @ among.T)
        here = np.arange(len(units))
        own = squares.argmin(axis=1)
        nearest = squares[here, own]
        between = np.sqrt(np.maximum(0, 2 - 2 * among @ among.T))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (squares - nearest[:, None]) / (2 * between[own])
        near = plane <= radius + MARGIN
        near[here, own] = False
        row, other = np.nonzero(near)
        rows, names = np.concatenate((here, row)), np.concatenate((own, other))
        was_home = part["home"].to_numpy(zero_copy_only=False).astype(bool)
        home = np.concatenate((was_home, np.zeros(len(row), bool)))
        ball = np.concatenate((was_home & (np.sqrt(nearest) <= radius / 2 - MARGIN), np.zeros(len(row), bool)))
        parent = part["cell"][0].as_py()
        found = copies.take(pa.array(rows))
        found = found.set_column(0, "cell", pa.array([f"{parent}.{j}" for j in names], pa.string()))
        found = found.set_column(1, "home", pa.array(home)).set_column(2, "ball", pa.array(ball))
        return found.add_column(0, "parent", pa.array([parent] * len(rows), pa.string()))

    rows = cells.join(small_or_shuffled(large), "cell")
    draw = F.pmod(F.xxhash64("pid", "cell"), "n_home") < 2 * F.col("pivots")
    drawn, path = stage(rows.where(F.col("home") & draw).select("cell", "pid", "vec", "pivots", "parts"), "vector-pivots")
    drawn = drawn.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("pid", F.lit(3)), "parts")).select(*cells.columns, "part")
    divided, divided_path = stage(parted.groupBy("cell", "part").cogroup(drawn.groupBy("cell", "part")).applyInArrow(assign, schema), "vector-cells")
    return divided, [path, divided_path]


def _sizes(cells: DataFrame, *keys: str) -> DataFrame:
    """Rows of each cell, and how many rows its comparison in blocks sends to tasks."""
    many = lambda n: F.ceil(n / BLOCK)
    home, ball, rest = F.col("n_home"), F.col("n_ball"), F.col("n_all") - F.col("n_ball")
    shell = home - ball
    cost = ball * many(rest) + rest * many(ball) + shell * many(ball + rest) + (ball + rest) * many(shell)
    counted = cells.groupBy(*keys, "cell").agg(F.count_if("home").alias("n_home"), F.count_if("ball").alias("n_ball"), F.count("*").alias("n_all"))
    return counted.withColumn("cost", cost)


def _cells(points: DataFrame, radius: float) -> tuple[list[DataFrame], list[str]]:
    """Tables of cells that a task, or blocks of them, can compare: ``cell, home, ball, pid, copies, vec``.

    A division is kept if it sends fewer rows than comparing the cell in blocks
    would, so every level at least gains, and near-identical vectors, which no
    pivots divide, end the descent."""
    cells, done, paths = points, [], []
    while True:
        sizes, path = stage(_sizes(cells), "vector-sizes")
        paths.append(path)
        large = sizes.where((F.col("n_all") > BLOCK) & (F.col("n_home") > 0))
        if large.isEmpty():
            return [*done, cells], paths
        pivots = F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(F.col("n_all") * 4 / BLOCK)))
        large = large.select("cell", "n_home", pivots.alias("pivots"), F.ceil(F.col("n_all") / BLOCK).alias("parts"))
        divided, made = _divided(cells, large, radius)
        paths += made
        children = _sizes(divided, "parent").groupBy("parent").agg(F.sum(F.col("cost") + F.col("n_all")).alias("below"))
        gains, path = stage(sizes.join(children, sizes["cell"] == children["parent"]).where("below < cost").select("parent"), "vector-gains")
        paths.append(path)
        done.append(cells.join(small_or_shuffled(gains.select(F.col("parent").alias("cell"))), "cell", "left_anti"))
        if gains.isEmpty():
            return done, paths
        # what a large cell that gains nothing leaves here is compared above
        cells = divided.join(small_or_shuffled(gains), "parent", "left_semi").drop("parent")
        cells, path = stage(cells, "vector-cells")
        paths.append(path)


def _spread(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the two-sided graph: ids and the root of each; every row is used once."""
    new_a, new_b = linked.any(axis=1), linked.any(axis=0)
    member, root = [], []
    while new_a.any():
        rows, cols = [np.flatnonzero(new_a)[:1]], []
        new_a[rows[0]] = False
        while len(rows[-1]):
            reached = np.flatnonzero(linked[rows[-1]].any(axis=0) & new_b)
            new_b[reached] = False
            cols.append(reached)
            back = np.flatnonzero(linked[:, reached].any(axis=1) & new_a) if len(reached) else reached
            new_a[back] = False
            rows.append(back)
        ids = np.concatenate((ids_a[np.concatenate(rows)], ids_b[np.concatenate(cols)]))
        member.append(ids)
        root.append(np.full(len(ids), ids.min()))
    none = np.zeros(0, np.int64)
    return np.concatenate((none, *member)), np.concatenate((none, *root))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of edges, and the least id that each hangs together with."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == least).all():
            return ids, ids[least]
        least = new


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """``pid, links, root``: the links of each row of one side to the other, and what hangs together."""

    def compare(group: pa.Table) -> pa.Table:
        role = group["role"].to_numpy()
        units, ids, copies = _units(group["vec"]), group["pid"].to_numpy(), group["copies"].to_numpy()
        mine, theirs = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        b, ids_b, copies_b = units[theirs], ids[theirs], copies[theirs]
        pid, links, member, root = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for tile in (mine[i : i + TILE] for i in range(0, len(mine), TILE)):
            linked = units[tile] @ b.T >= threshold
            linked &= ids[tile][:, None] != ids_b[None, :]
            counts = linked @ copies_b
            some = counts > 0
            pid.append(ids[tile][some])
            links.append(counts[some])
            x, y = _spread(linked, ids[tile], ids_b)
            member.append(x)
            root.append(y)
        x, y = _roots(np.concatenate(member), np.concatenate(root))
        found = {"pid": np.concatenate((*pid, x)), "links": np.concatenate((*links, np.zeros(len(x), np.int64)))}
        return pa.table(found | {"root": np.concatenate((*pid, y))})

    return rows.groupBy("cell", "side", "block_a", "block_b").applyInArrow(compare, "pid long, links long, root long")


def _blocks(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each cell's rows as the two sides of its comparisons: what lies in its ball with
    the rest, and the other home rows with all; within the ball nothing is compared."""
    many = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("long")
    shell, rest = F.col("n_home") - F.col("n_ball"), F.col("n_all") - F.col("n_ball")
    sizes = sizes.where("n_home > 0").select("cell", many(F.col("n_ball")).alias("ball_a"), many(rest).alias("ball_b"), many(shell).alias("shell_a"), many(F.col("n_all")).alias("shell_b"), (F.col("n_ball") > 0).alias("has_ball"))
    rows = cells.join(small_or_shuffled(sizes), "cell")
    draw = F.xxhash64("pid", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def side(rows: DataFrame, name: str, role: int) -> DataFrame:
        mine, other = ("a", "b") if role == 0 else ("b", "a")
        blocks = (F.pmod(draw, f"{name}_{mine}").alias(f"block_{mine}"), every(f"{name}_{other}").alias(f"block_{other}"))
        return rows.select("cell", F.lit(name).alias("side"), F.lit(role).alias("role"), "pid", "copies", "vec", *blocks).select("cell", "side", "block_a", "block_b", "role", "pid", "copies", "vec")

    balls = rows.where("has_ball")
    return (
        side(rows.where("home AND NOT ball"), "shell", 0)
        .union(side(rows, "shell", 1))
        .union(side(balls.where("ball"), "ball", 0))
        .union(side(balls.where("NOT ball"), "ball", 1))
    )


def link_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their labels are equal and not null, their lengths
    agree and their cosine in double precision is at least ``threshold``.
    Null and zero vectors and those with null or non-finite components link
    with nothing: ``n_links`` 0, own component. ``component_id`` is the
    smallest id reachable (null ids are passed over), ``kept`` whether the
    row has that id. Repeated rows are vectors of their own that link with
    each other; equal vectors, told by 128 bits of hashes and their label, are
    compared once and counted as often as they occur. Ids may be of any type
    that has an order. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.elementType.typeName()
    vec = F.col(vec_col) if kind in ("float", "double") else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("lab"), vec.alias("vec"), F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(7), vec).alias("h2"))
    usable = _usable(F.col("vec")) & F.col("lab").isNotNull()
    points = rows.where(usable).groupBy("lab", "h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    points, points_path = stage(points.withColumn("pid", F.monotonically_increasing_id()), "vector-points")
    radius = math.sqrt(2 - 2 * threshold)
    whole = points.select(F.concat_ws(":", F.col("lab").cast("string"), F.size("vec")).alias("cell"), F.lit(True).alias("home"), F.lit(False).alias("ball"), "pid", "copies", "vec")
    tables, paths = _cells(whole, radius)

    parts = []
    for cells in tables:
        sizes, path = stage(_sizes(cells), "vector-sizes")
        found, found_path = stage(_compare(_blocks(cells, sizes), threshold), "vector-links")
        balls = cells.where("ball")
        facts, facts_path = stage(balls.groupBy("cell").agg(F.sum("copies").alias("all"), F.min("pid").alias("root")), "vector-balls")
        parts += [found, balls.join(small_or_shuffled(facts), "cell").select("pid", (F.col("all") - F.col("copies")).alias("links"), "root")]
        paths += [path, found_path, facts_path]
    found, found_path = stage(reduce(DataFrame.union, parts), "vector-links")
    unstage(spark, *paths)

    counts = found.groupBy("pid").agg(F.sum("links").alias("links"))
    hang = components(found.select(F.col("pid").alias("a"), F.col("root").alias("b")))
    hang, hang_path = stage(hang.join(points.select(F.col("pid").alias("node"), "least_id"), "node"), "vector-hang")
    names, names_path = stage(hang.groupBy("component").agg(F.min("least_id").alias("component_id")), "vector-names")
    named = hang.join(small_or_shuffled(names), "component").select(F.col("node").alias("pid"), "component_id")
    facts = points.join(counts, "pid", "left").join(named, "pid", "left").select(
        "lab", "h1", "h2", F.coalesce("component_id", "least_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    facts, _ = stage(facts, "vector-facts")  # read anew, so that a hot vector's rows split in the join below
    unstage(spark, points_path, found_path, hang_path, names_path)
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    together = rows.where(usable).join(facts, ["lab", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    return together.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of ``embeddings`` of equal label at cosine 0.93; unusable vectors
    and null labels link with nothing; see ``link_vectors``."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force. Components: labels spread along links until nothing changes.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS vec_id, a AS near FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.near = l.a),
c AS (SELECT vec_id, min(near) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
