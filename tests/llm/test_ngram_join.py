"""The n-gram join against all pairs."""

import random
import re

import pytest

from sextant.llm import ngram_join
from sextant.llm.ngram_join import near_components


def brute(rows, k, t_num, t_den):
    def shingles(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * t_den >= t_num * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if t_den * both >= t_num * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def made(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    common = [rnd.choice(words) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.5:
            ws = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                if ws:
                    ws[rnd.randrange(len(ws))] = rnd.choice(words)
            if rnd.random() < 0.3:
                ws = ws + rnd.sample(words, rnd.randrange(4))
        else:
            ws = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 8, 20, 60, 140]))]
            if rnd.random() < 0.4:
                ws = common + ws
        texts.append(" ".join(ws))
    return [(i, t.upper() if i % 9 == 0 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (2, 1, 6, 10), (3, 5, 8, 10), (4, 2, 7, 10), (5, 1, 9, 10)])
def test_against_all_pairs(spark, seed, k, num, den):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((tuple(r)[:3] for r in near_components(docs, k, num / den, 8 if seed % 2 else 20).collect()), key=repr)
    assert got == brute(rows, k, num, den)


@pytest.mark.parametrize(("hot", "seed"), [(1, 1), (2, 2)])
def test_sets_alone_in_their_salt_group_keep_their_links(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((tuple(r)[:3] for r in near_components(docs, 2, 0.7).collect()), key=repr)
    assert got == brute(rows, 2, 70, 100)


def test_documents_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r)[:3] for r in near_components(docs, 4, 0.85).collect()), key=repr)
    assert got == brute(rows, 4, 85, 100)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e f"), (5, "A b c d e f"), (5, "A b c d e f"), (6, "a b"), (7, "a b"), (8, "a b c")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, sid long")
    got = sorted((tuple(r)[:3] for r in near_components(docs, 4, 0.85).collect()), key=repr)
    assert got == brute(rows, 4, 85, 100)
    assert near_components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_components(docs, 4, 0.3)


def test_slices_of_many_tasks_are_added_level_by_level(spark):
    import numpy as np
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, np.array([i, 1, 2**30], np.int32).tobytes()) for i in range(2000)], "task int, counts binary")
    slices = frame.select("task", F.explode(F.array(F.lit(0), F.lit(1))).alias("slice"), "counts")
    got = ngram_join._summed(slices, 2000)
    assert got.tolist() == [[1999000, 2000, 2**31 - 1]] * 2


def test_a_passage_that_many_unlike_texts_share_gives_few_pairs(spark, monkeypatch):
    """Texts of one long passage and 9 to 14 % of their own share signatures, and link with nothing."""
    rnd = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, passage + " " + " ".join(f"u{i}x{j}" for j in range(rnd.randrange(13, 21)))) for i in range(150)]
    rows += [(1000 + i, t + " z") for i, t in rows[:5]]
    counted = {}

    def counting(df, name, keep=ngram_join.stage):
        table, path = keep(df, name)
        counted[name] = max(counted.get(name, 0), table.count()) if name in ("ngram-rest", "ngram-open", "ngram-tried") else 0
        return table, path

    monkeypatch.setattr(ngram_join, "stage", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in near_components(docs, 1, 0.85).collect()), key=repr)
    assert got == brute(rows, 1, 85, 100)
    assert counted["ngram-rest"] <= 3 * len(rows)


def test_near_copies_are_dropped_by_row(spark):
    """Repeated ids, repeated rows and extra columns, also of names that the operator uses."""
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (2, long + " x"), (2, "another text of a few words here"), (None, long), (3, "a"), (3, "a"), (4, None), (4, None), (5, "A")]
    docs = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "doc_id long, text string, g_id int, _set int")
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.g_id for r in kept.collect()) == [0, 2, 4, 5, 6, 7]


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), (None, "x y z"), ("c", "")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in near_components(docs).collect()} == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c")}


@pytest.mark.parametrize("load", [1, 64, 4096, 2**20])
def test_frequent_tokens_stand_out_however_loaded_the_sketch_is(load):
    """Tokens in a hundredth of the sets and more are frequent at any size, single ones are not."""
    import numpy as np

    draw = np.random.default_rng(load)
    sets, width = 4000 * load, 1 << 14
    sketch = draw.poisson(0.5 * load, (2, width)).astype(np.int64)
    tokens = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    shares = draw.uniform(0.01, 0.2, 200)
    for line, slots in zip(sketch, ngram_join._slots(tokens, width), strict=True):
        np.add.at(line, slots[:200], (shares * sets).astype(np.int64))
        np.add.at(line, slots[200:], 1)
    _, frequent = ngram_join._noise(sketch)
    one, two = ngram_join._slots(tokens, width)
    often = np.minimum(sketch[0][one], sketch[1][two]) > frequent
    assert often[:200].all() and often[200:].mean() < 0.01
