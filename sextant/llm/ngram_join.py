"""N-gram Jaccard join with token-combination prefixes.

Tokens are a document's distinct word shingles. In one order of all tokens,
rare first, two similar sets share enough of the shorter prefix. The prefix
is extended until it covers what may differ, where tokens of the rare class
count singly and those of the frequent class by pairs within small hash
classes; single rare tokens and pairs of frequent ones are the signatures.
Sets that share a signature are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, small_or_shuffled, stage, unstage, unused
from .spans import SEPARATOR, chunks, code_points, hashes

#: Width of the frequency sketch (two rows). Every task holds it, so it must not grow with
#: the data; what does is its noise, the singletons in every slot, which ``_noise`` measures.
SKETCH_BITS = 20
#: Slices of the sketch, and how many tasks' slices are added at once.
SLICES, FAN_IN = 64, 64
#: Signatures estimated in more sets than this are split among so many more groups.
HOT = 2048


def _shingles(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    codes, starts = code_points(texts)
    codes = np.where((codes >= 0x41) & (codes <= 0x5A), codes + 32, codes)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D)) | (codes == SEPARATOR)
    edge = np.concatenate(([True], blank))
    first = np.flatnonzero(edge[:-1] & ~blank)
    last = np.flatnonzero(~edge[1:] & np.concatenate((blank[1:], [True]))) + 1
    words = hashes(codes, first, last)
    bounds = np.searchsorted(first, starts)
    # a shingle is a span of words
    n = len(words)
    spans = hashes(words, np.arange(max(0, n - k + 1)), np.arange(max(0, n - k + 1)) + k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(spans[a : b - k + 1])
        elif b > a:
            yield hashes(words[a:b], np.array([0]), np.array([b - a]))
        else:
            yield np.zeros(0, np.uint64)


def _set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    mixed = (tokens ^ (tokens >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    a = int(mixed.sum(dtype=np.uint64)) ^ len(tokens)
    b = int(np.bitwise_xor.reduce(mixed * (mixed | np.uint64(1)))) if len(tokens) else 0
    signed = lambda x: (x * 0x94D049BB133111EB & (1 << 64) - 1) - (1 << 63)
    return signed(a), signed(b)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    return chain.from_iterable(_shingles(part, k) for part in chunks(x or "" for x in texts.to_pylist()))


def _slots(tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(width - 1)
    return (tokens & mask).astype(np.int64), ((tokens >> np.uint64(32)) & mask).astype(np.int64)


def _describe(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Size and two digests of each document's set, and each task's share of the
    sketch, in slices."""
    kind = docs.schema["doc_id"].dataType
    rest = T._parse_datatype_string("text_hash long, n long, sid long, chk long, task int, slice int, counts binary").fields
    schema = T.StructType([T.StructField("doc_id", kind), *rest])
    names = schema.names

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, task = np.zeros((2, 1 << bits), np.int64), TaskContext.get().partitionId()
        empty = None
        for batch in batches:
            empty = batch.slice(0, 0)
            found = []
            for tokens in _sets(batch.column("text"), k):
                for line, slots in zip(counts, _slots(tokens, 1 << bits), strict=True):
                    line[slots] += 1
                found.append((len(tokens), *_set_keys(tokens)))
            columns = np.array(found, np.int64).reshape(-1, 3).T
            nothing = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, columns), *nothing], names)
        if counts.any():
            flat = np.minimum(counts, 2**31 - 1).astype(np.int32).reshape(SLICES, -1)
            blank = [pa.nulls(SLICES, t) for t in (empty.schema.field("doc_id").type, *[pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([task] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(describe, schema)


def _summed(slices: DataFrame, tasks: int) -> np.ndarray:
    """Sum of the tasks' ``task, slice, counts``. However many tasks there are, at
    most FAN_IN slices are added at once, level by level."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["counts"].iloc[0]) // 4, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, np.int32)
        counts = np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()
        return pd.DataFrame({"task": [group["task"].iloc[0] // FAN_IN], "slice": [group["slice"].iloc[0]], "counts": [counts]})

    while tasks > 1:
        slices = slices.groupBy("slice", F.floor(F.col("task") / FAN_IN)).applyInPandas(add, "task int, slice int, counts binary")
        tasks = -(-tasks // FAN_IN)
    return np.stack([np.frombuffer(r["counts"], np.int32) for r in slices.orderBy("slice").collect()])


def _sketch(described: DataFrame, bits: int) -> np.ndarray:
    slices = described.where("slice IS NOT NULL").select("task", "slice", "counts")
    last = slices.agg(F.max("task")).first()[0]
    return np.zeros((2, 1 << bits), np.int32) if last is None else _summed(slices, max(2, last + 1)).reshape(2, -1)


def _noise(sketch: np.ndarray) -> tuple[float, float]:
    """What rare tokens alone load a slot with: usually, and hardly ever more than.

    Half of the slots hold no frequent token, so their median is that load; sums of many
    rare tokens spread as its square root. As data grow the load grows with them,
    but a token in a given share of sets rises above it ever more clearly."""
    usual = float(np.median(sketch[0]))
    return usual, usual + 6 * math.sqrt(usual) + 32


def _pair_hash(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(level))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


def _signatures(tokens: np.ndarray, sketch: np.ndarray, frequent: float, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, how many sets are estimated to have each, and what
    the tokens before it cover.

    Order: estimated frequency, then hash. Pairs are formed within 2**(level-2)
    hash classes; the level follows the set's size, and a set takes part in
    the levels of all larger sizes it may be similar to, so that similar sets
    meet in one. For t >= 0.6 a set of two or more tokens always covers what
    may differ; a set of one token is similar to equal sets only. If a
    signature is the first that two sets share, at least as many tokens as
    those before it cover are missing from the other set.
    """
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < 2:
        return np.zeros(0, np.uint64), none, none
    one, two = _slots(tokens, sketch.shape[1])
    estimate = np.minimum(sketch[0][one], sketch[1][two])
    need = n + int(-(t * n) // 1) + 1  # n - ceil(t n) + 1
    order = np.lexsort((tokens, estimate))
    ordered, estimate = tokens[order], estimate[order].astype(np.int64)
    often = estimate > frequent
    where_often = np.flatnonzero(often)
    signs, counts, covers = [], [], []
    single, before_single = 0, None
    for level in range(n.bit_length() - 1, int(n / t).bit_length()):
        cover = np.ones(n, np.int64)
        group = (ordered[where_often] >> np.uint64(11)) % np.uint64(1 << max(0, level - 2))
        cover[where_often[np.unique(group, return_index=True)[1]]] = 0
        total = np.cumsum(cover)
        before = total - cover
        end = int(np.searchsorted(total, need)) + 1
        single, before_single = max(single, end), before if before_single is None else np.minimum(before, before_single)
        group, where = group[where_often < end], where_often[where_often < end]
        by = np.lexsort((where, group))
        group, where = group[by], where[by]
        for step in range(1, len(where)):
            hit = np.flatnonzero(group[step:] == group[:-step])
            if not len(hit):
                break
            x, y = where[hit], where[hit + step]  # y comes later in the order
            signs.append(_pair_hash(level, ordered[x], ordered[y]))
            counts.append(np.minimum(estimate[x], estimate[y]))
            covers.append(before[y])
    rare = np.flatnonzero(~often[:single])
    return np.concatenate((ordered[rare], *signs)), np.concatenate((estimate[rare], *counts)), np.concatenate((before_single[rare], *covers))


SIGNATURE_SCHEMA = "sig long, salt int, sid long, chk long, n int, cov int"
SIGNATURE = [x.split()[0] for x in SIGNATURE_SCHEMA.split(", ")]
SHARED_SCHEMA = f"{SIGNATURE_SCHEMA}, rep_sid long, rep_chk long, rep_n int, rep_cov int"


def _emit(docs: DataFrame, k: int, sketch: np.ndarray, t: Fraction) -> DataFrame:
    """The signatures of all sets. A token in one document only has no partner: the
    sketch never counts too few, so its signatures are left out."""
    usual, frequent = _noise(sketch)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], SIGNATURE)

        for batch in batches:
            for tokens in _sets(batch.column("text"), k):
                if len(tokens) < 2 or (key := _set_keys(tokens)) in seen:  # equal sets only; or a copy met in this task
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                signs, counts, covers = _signatures(tokens, sketch, frequent, t)
                some = counts > 1
                signs, counts, covers = signs[some], np.maximum(0, counts[some] - int(usual)), covers[some]
                salts = np.where(counts >= 2 * HOT, 1 + (np.int64(key[0]) & 0x7FFFFFFF) % np.maximum(1, counts // HOT), 0)
                m = len(signs)
                held.append((signs.view(np.int64), salts.astype(np.int32), np.full(m, key[0]), np.full(m, key[1]), np.full(m, len(tokens), np.int32), covers.astype(np.int32)))
                size += m
                if size > 200_000:
                    yield batch_of()
                    held, size = [], 0
        if held:
            yield batch_of()

    return docs.select("text").mapInArrow(emit, SIGNATURE_SCHEMA)


def _shared(signatures: DataFrame) -> DataFrame:
    """Rows of signatures that two or more sets have, with the group's first row:
    the set of which least comes before, so the one most like the others.

    Sorted rows stream through; nothing but the group's first row is held.
    Estimated hot signatures arrive in several groups, by salt from 1 on; a set
    alone in such a group stays, as the others may lie in the signature's other groups.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead: list[int] | None = None  # the open group's first row
        told = False  # whether it has been handed on
        for batch in batches:
            if batch.empty:
                continue
            rows = batch[SIGNATURE].to_numpy(np.int64)
            if lead is not None:  # go on where the last batch ended
                rows = np.vstack((np.array([lead]), rows))
            new = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            other = (rows[:, 2:4] != rows[first, 2:4]).any(axis=1)
            fresh = np.concatenate(([True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)))
            shared = np.zeros(len(rows), bool)
            shared[first[other]] = True
            shared |= new & (rows[:, 1] > 0)
            last_start = int(first[-1])
            keep = (other & fresh) | (new & shared)
            if lead is not None and told:
                keep[0] = False
            told = bool(shared[last_start]) or (last_start == 0 and lead is not None and told)
            lead = rows[last_start].tolist()
            if keep.any():
                out = np.hstack((rows[keep], rows[first[keep]][:, 2:]))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in SHARED_SCHEMA.split(", ")]).astype(dict.fromkeys(("salt", "n", "cov", "rep_n", "rep_cov"), "int32"))

    dealt = signatures.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "cov", "sid", "chk")
    return dealt.mapInPandas(pick, SHARED_SCHEMA)


def _node(sid: str, chk: str) -> Column:
    """Both digests of a set as one key of 16 bytes."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (sid, chk))))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs ``a, b`` whose sets' intersection is at least t of their union.

    One text stands for each set; texts pack better than their tokens' hashes."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            for column, text in (("a", "text_a"), ("b", "text_b")):
                new = batch[~batch[column].isin(known.keys())].drop_duplicates(column)
                known.update(zip(new[column], chain.from_iterable(_shingles(part, k) for part in chunks(new[text])), strict=True))
            found = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                x, y = known[a], known[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if t.denominator * both >= t.numerator * (len(x) + len(y) - both):
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=object)

    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted, wanted_path = stage(sets.join(needed, "node", "left_semi").select("node", F.col("rep.doc_id").alias("w_id"), F.col("rep.text_hash").alias("w_hash")), "ngram-wanted")
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.xxhash64("text") == F.col("w_hash"))
    texts = docs.select("doc_id", "text").join(small_or_shuffled(wanted), same).select("node", "text").dropDuplicates(["node"])
    texts, texts_path = stage(texts, "ngram-texts")
    x, y = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
    links, _ = stage(joined.mapInPandas(verify, "a binary, b binary"), "ngram-links")
    unstage(pairs.sparkSession, wanted_path, texts_path)
    return links


def near_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    r"""One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, text_hash``.

    Words are ``[^\x20\x09-\x0D]+`` of the whole text with A-Z lower-cased; a set
    holds the distinct ``k``-word shingles, with fewer words the whole sequence
    as one; no words or null text: empty, linked with nothing. Sets link when
    intersection over union is at least ``similarity`` (0.6 or more, taken as
    an exact fraction). ``component_id`` is the smallest id reachable by
    links (null ids are passed over). Repeated rows have equal sets and share
    a component. ``text_hash`` is Spark's ``xxhash64`` of the text. Ids may be of
    any type that has an order. An empty table gives an empty result; other
    columns, whatever their names, are ignored.

    Equal sets are one set from the start. In the first round each set is
    verified against the first set of each of its signatures, so groups of
    copies cost one comparison a member. In the second, signatures whose sets
    still lie in different components give pairs across these, so no link is
    lost: the smaller set's signature must lie early enough for it to be the
    smaller one of a similar pair, sizes must be within one band, and a pair is
    left out where the tokens before the signature show that it cannot be
    similar: two similar sets pass at the first signature that they share.
    So a passage that many unlike texts share gives no pairs. Tokens are told
    apart by 64-bit hashes, sets by 128 bits.
    """
    t = Fraction(similarity).limit_denominator(1000)
    if not Fraction(6, 10) <= t <= 1:
        raise ValueError("similarity must be from 0.6 to 1")
    spark = docs.sparkSession
    described, _ = stage(_describe(docs, k, sketch_bits), "ngram-sets")
    rows = described.where("slice IS NULL").select("doc_id", "text_hash", "n", "sid", "chk")
    sets = rows.where("n > 0").groupBy("sid", "chk").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    sets, sets_path = stage(sets.withColumn("node", _node("sid", "chk")), "ngram-distinct")
    shared, shared_path = stage(_shared(_emit(docs, k, _sketch(described, sketch_bits), t)), "ngram-signatures")

    p, q = t.numerator, t.denominator
    big = lambda c: F.col(c).cast("long")

    def possible(n: str, cov: str, o_n: str, o_cov: str) -> Column:
        """Sizes allow the similarity, and so does what comes before the signature."""
        overlap = F.least(big(n) - big(cov), big(o_n) - big(o_cov)) * (p + q) >= (big(n) + big(o_n)) * p
        return overlap & (F.least(big(n), big(o_n)) * q >= F.greatest(big(n), big(o_n)) * p)

    def pairs(found: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
        return found.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()

    # salted groups of one signature, of one set too, meet by their first rows
    own = (F.col("salt") > 0) & (F.col("sid") == F.col("rep_sid")) & (F.col("chk") == F.col("rep_chk"))
    leads = shared.where(own).select("sig", F.struct("rep_cov", "rep_sid", "rep_chk", "rep_n").alias("lead"))
    tops = leads.groupBy("sig").agg(F.min("lead").alias("top"), F.count("*").alias("groups")).where("groups > 1")
    fields = {"sid": "rep_sid", "chk": "rep_chk", "n": "rep_n", "cov": "rep_cov"}
    joint = leads.join(tops, "sig").select(*(F.col(f"lead.{c}").alias(name) for name, c in fields.items()), *(F.col(f"top.{c}").alias(c) for c in fields.values()))
    stars = shared.select(*joint.columns).union(joint).where(possible("n", "cov", "rep_n", "rep_cov"))
    tried, tried_path = stage(pairs(stars, _node("sid", "chk"), _node("rep_sid", "rep_chk")), "ngram-tried")
    links = _verified(tried, docs, sets, k, t)
    hang, hang_path = stage(components(links), "ngram-hang")

    placed = shared.select("sig", _node("sid", "chk").alias("node"), "n", "cov").join(hang, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sig")
    width = math.log(1 / t) * (1 + 1e-9)
    band = F.floor(F.log(big("n")) / width).cast("int") if t < 1 else F.col("n")
    open_sets, open_path = stage(placed.join(mixed, "sig", "left_semi").withColumn("band", band), "ngram-open")
    smaller = open_sets.where(big("cov") * (q + p) <= big("n") * (q - p)).select("sig", "band", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "cov", "comp")))
    larger = open_sets.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))) if t < 1 else open_sets
    across = larger.join(smaller, ["sig", "band"]).where((F.col("n") >= F.col("o_n")) & (F.col("comp") != F.col("o_comp")) & possible("n", "cov", "o_n", "o_cov"))
    rest, rest_path = stage(pairs(across, "node", "o_node").join(tried, ["a", "b"], "left_anti"), "ngram-rest")
    unstage(spark, shared_path, hang_path, open_path)
    more = _verified(rest, docs, sets, k, t)
    hang, hang_path = stage(components(links.union(more)), "ngram-hang")

    # set -> component -> smallest id
    linked, linked_path = stage(sets.join(hang, "node").select("node", "component", "least_id"), "ngram-linked")
    names = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named, named_path = stage(linked.join(names, "component").select("node", F.col("component_id").alias("named")), "ngram-named")
    facts = sets.join(named, "node", "left").select("sid", "chk", F.coalesce("named", "least_id").alias("component_id"))
    facts, _ = stage(facts, "ngram-facts")  # read anew, so that the join below is between plain shuffles and a hot set's rows split
    unstage(spark, sets_path, tried_path, rest_path, hang_path, linked_path, named_path)
    full = rows.where("n > 0").join(facts, ["sid", "chk"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash")
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash"))


def drop_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id.

    Rows are addressed by id and a hash of the text, so that a repeated or null
    id drops no other text; rows that repeat both stay or go together.
    Documents without words stay. All columns stay as they are.
    """
    found = near_components(docs.select("doc_id", "text"), k, similarity)
    g_id, g_hash = unused("g_id", docs.columns), unused("g_hash", docs.columns)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(g_id), F.col("text_hash").alias(g_hash)).distinct()
    gone, _ = stage(gone, "ngram-gone")
    return docs.join(small_or_shuffled(gone), F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.xxhash64("text") == F.col(g_hash)), "left_anti")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by four-word shingles at 0.85; texts without words link with
    nothing, equal ones with each other; see ``near_components``."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4, similarity=0.85).drop("text_hash")
