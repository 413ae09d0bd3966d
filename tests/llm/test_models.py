"""Language ID, toxicity and the pipeline: brute force and held-out accuracy."""

import importlib.util
import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sextant.llm import langid, toxicity
from sextant.llm.bpe import tokenizer_path

from test_ngram_join import brute

DIR, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"  # of the smaller one, six toxic documents are held out
SMALL = "/root/testdata/sf0.001"
PIECES = ["a", "b", "ab", "ba", "aba", "▁a", "▁ab", "▁b", "▁"]


def cuts(word):
    for marks in product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(word)]
        yield [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def total(word, prob):
    """The sum over all segmentations, one after another."""
    return sum(math.prod(prob.get(p, langid.UNKNOWN if len(p) == 1 else 0.0) for p in cut) for cut in cuts(word))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    prob = rng.random((len(PIECES), 2))
    words = ["▁a", "▁ab", "▁abab", "▁bbaabab", "▁xaby", "▁zz", "▁abc"]
    got = langid.word_logs(words, langid.Pieces(PIECES), prob)
    for word, row in zip(words, got, strict=True):
        for j in range(2):
            assert row[j] == pytest.approx(math.log(total(word, dict(zip(PIECES, prob[:, j], strict=True)))))


def test_expected_counts_weigh_all_segmentations():
    rng = np.random.default_rng(2)
    prob = rng.random(len(PIECES))
    by = dict(zip(PIECES, prob, strict=True))
    words, n = ["▁abab", "▁ba", "▁xab"], np.array([3.0, 1.0, 2.0])
    want = Counter()
    for word, m in zip(words, n, strict=True):
        for cut in cuts(word):
            p = math.prod(by.get(x, langid.UNKNOWN if len(x) == 1 else 0.0) for x in cut)
            for x in cut:
                want[x] += m * p / total(word, by)
    got = langid._expected(words, n, langid.Pieces(PIECES), prob)
    assert got == pytest.approx([want[p] for p in PIECES])


def test_languages_of_held_out_documents(spark):
    rows = langid.op2_langid(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(known) > 100 and np.mean([r.lang == r.lang_pred for r in known]) > 0.97
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))


def test_languages_of_odd_rows(spark):
    rows = [(1, "the house", "en"), (2, "das haus", "de"), (3, None, "en"), (4, "", "de"), (5, "12 34 !?", None), (None, "the house", None), (6, "x" * 200_000, None), (1, "the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs, langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    assert model.languages == ["de", "en"]
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = [(r.text, r.lang_pred, r.score) for r in got.collect()]
    assert len(found) == len(rows) and {p for t, p, _ in found if t == "the house"} == {"en"}
    assert {(p, s) for t, p, s in found if t in (None, "", "12 34 !?")} == {("und", 0.0)}
    nothing = langid.fit(docs.limit(0), ["a"])
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def plain_sum(word, prob, longest):
    """The forward sum of one word, letter by letter, in logs."""
    logs = [0.0]
    for end in range(1, len(word) + 1):
        parts = ((n, prob.get(word[end - n : end], langid.UNKNOWN if n == 1 else 0.0)) for n in range(1, min(end, longest) + 1))
        logs.append(logs[-1] + math.log(sum(math.exp(logs[end - n] - logs[-1]) * p for n, p in parts)))
    return logs[-1]


def test_long_words_and_long_pieces_are_summed_whole():
    rng = np.random.default_rng(3)
    pieces = [*PIECES, "abababababab", "▁ababababab", "bababababababababa"]
    prob = rng.random((len(pieces), 3))
    words = ["▁" + "".join(rng.choice(list("abx"), size=n)) for n in (1, 8, 33, 49, 80, 200, 5000)] + ["▁" + "ab" * n for n in (20, 60)]
    got = langid.word_logs(words, langid.Pieces(pieces), prob)
    for word, row in zip(words, got, strict=True):
        for j in range(3):
            assert row[j] == pytest.approx(plain_sum(word, dict(zip(pieces, prob[:, j], strict=True)), 18))


def test_expected_counts_of_long_words_stay_whole():
    """Letters covered by expected pieces and unknown ones are the word's letters."""
    prob = np.full(len(PIECES), 0.1)
    words = ["▁" + "ab" * 100, "▁ab"]
    got = langid._expected(words, np.array([1.0, 2.0]), langid.Pieces(PIECES), prob)
    assert got @ [len(p) for p in PIECES] == pytest.approx(201 + 2 * 3)


def test_score_of_a_text_is_the_posterior_of_its_words():
    rng = np.random.default_rng(5)
    prob = rng.random((len(PIECES), 2))
    model = langid.Model(["de", "en"], PIECES, prob)
    langs, scores = model.predict(["Ab aba\nXY 7 bb", "ab", ""])
    for text, lang, score in zip(["ab aba xy bb", "ab", ""], langs, scores, strict=True):
        logs = [sum(plain_sum("▁" + w, dict(zip(PIECES, prob[:, j], strict=True)), 3) for w in text.split()) for j in range(2)]
        if not text:
            assert (lang, score) == ("und", 0.0)
            continue
        assert lang == ["de", "en"][int(logs[1] > logs[0])] and score == pytest.approx(1 / (1 + math.exp(-abs(logs[1] - logs[0]))))


MARK_OF = {c: symbol for symbol, characters in toxicity.MARKS.items() for c in characters}


def walked(text, forms=None):
    """The grammar of a text, read word by word without the machines."""
    import regex

    kind_of = {w: (k, 1.0) for w, (k, _) in toxicity.built_in().items()}
    stems = {t: v for (n, t), v in (forms or {}).items() if n}
    kind_of = {t: v for (n, t), v in (forms or {}).items() if not n} | kind_of

    def kind(word):
        if word in MARK_OF:
            return MARK_OF[word], 0.0
        if (low := word.lower()) in kind_of:
            return kind_of[low]
        for n in sorted(map(len, stems)):
            if len(low) >= n and low[:n] in stems:
                return stems[low[:n]]
        return toxicity.PLAIN, 0.0

    found = np.zeros(len(toxicity.OUTPUTS))
    for line in text.split("\n"):
        read = [kind(w) for w in regex.findall(r"\p{L}+|[.!?;:\"“”„«»]", line)]
        for i, (k, arc) in enumerate(read):
            if k not in (toxicity.INSULT, toxicity.THREAT):
                continue

            def near(trigger, reach, side, ends=toxicity.ENDS):
                words = 0
                for x, _ in side:
                    if x in ends:
                        return 0
                    if x > toxicity.PLAIN:  # marks are no words
                        continue
                    words += 1
                    if words > reach:
                        return 0
                    if x == trigger:
                        return 1
                return 0

            left, right = read[:i][::-1], read[i + 1 :]
            left_of = lambda t: near(t, toxicity.LEFT_REACH[t], left)  # noqa: B023, E731
            sentence = next((n for n, (x, _) in enumerate(left) if x == toxicity.SENTENCE), len(left))
            reported = any(x == toxicity.REPORT for x, _ in left[:sentence]) or sum(x == toxicity.QUOTE for x, _ in left) % 2
            reported = reported or near(toxicity.REPORT, toxicity.RIGHT_REACH[toxicity.REPORT], right, (toxicity.SENTENCE,))
            negated = left_of(toxicity.NEGATION) or (k == toxicity.THREAT and near(toxicity.NEGATION, toxicity.RIGHT_REACH[toxicity.NEGATION], right))
            aimed = left_of(toxicity.TARGET) if k == toxicity.INSULT else near(toxicity.TARGET, toxicity.OBJECT_REACH, left)
            aimed = aimed or near(toxicity.TARGET, toxicity.RIGHT_REACH[toxicity.TARGET], right)
            found[toxicity.OUTPUTS.index((k, int(aimed), int(negated), int(reported)))] += arc
    return found


def test_machines_read_as_the_grammar_says():
    texts = [
        "You are an idiot.", "you are not an idiot", "He said you are an idiot", "He said: you idiot", "I will kill you; you. kill", "", "!!", "IDIOT", "Tu es un imbécile\nno you stupid fool",
        "you a b c d e idiot you a b c d e f idiot", "not a b idiot not a b c idiot", "idiot " * 500, "I will kill you.", "hurt", "Idiot, you", '"You idiot," he said', 'They shouted "you idiot. Idiot!" Idiot',
        "ich töte dich nicht töten dich nicht", "kill a b c you", 'a " idiot\nidiot " idiot', "\n\nidiot\n", "said; idiot: idiot. idiot", "idiot a b said idiot a b c said",
    ]
    rng = np.random.default_rng(6)
    bits = ["you", "idiot", "kill", "not", "said", "word", "a", ".", ":", '"', "\n", ";", "“", "”"]
    texts += [" ".join(rng.choice(bits, size=n)) for n in (3, 10, 30, 100) for _ in range(40)]
    forms = {(0, "word"): (toxicity.TARGET, 1.0), (5, "blorp"): (toxicity.INSULT, 0.5), (4, "zark"): (toxicity.THREAT, 0.25), (0, "gabs"): (toxicity.REPORT, 1.0)}
    learned = ["you blorped", "Blorpish zarkling gabs", "he gabs: blorper", "zark word zarkzark", "zarking you", "blor zar blorp"]
    for model, known, many in ((toxicity._model({}), None, texts), (toxicity._model(forms), forms, texts + learned)):
        for text, row in zip(many, model.counts(many), strict=True):
            assert row.tolist() == walked(text, known).tolist(), text
    model = toxicity._model({})
    score = dict(zip(texts, model.scores(texts), strict=True))
    assert score["You are an idiot."] > max(score["IDIOT"], score["you are not an idiot"], score["He said you are an idiot"]) > score[""]
    assert score["I will kill you."] >= 0.5 > score["hurt"] == score[""] and score["Idiot, you"] >= 0.5
    tame = ["This garbage collector is fast", "these trash cans", "you should kill the process", "I won't hurt you", "They wouldn't hurt you"]
    assert max(model.scores(tame)) < 0.5 <= min(model.scores(["I will kill you", "Ich werde dich umbringen", "you garbage"]))
    assert max(score["He said: you idiot"], score['"You idiot," he said']) < 0.5


def test_learned_forms_may_be_insults_threats_targets_or_reporting_words():
    rng = np.random.default_rng(7)
    filler = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna"]
    pad = lambda n=4: " ".join(rng.choice(filler, size=n))
    toxic = [f"{pad()} frobnik {pad()} frobnik {i}" for i in range(40)] + [f"{pad()}. I zarkle you. {pad()}" for _ in range(40)]
    toxic += [f"{pad()}. idiot wugs. {pad()}" for _ in range(60)]
    clean = [f"{pad()}. I zarkle {pad()} {i}" for i in range(9)] + [f"{pad()}. quoth dumb idiot. {pad()}" for _ in range(60)] + [f"{pad()} wugs {pad()}" for _ in range(200)]
    forms = toxicity._learned(toxic + clean, np.array([1] * len(toxic) + [0] * len(clean)))
    kind = lambda word: {v[0] for (n, t), v in forms.items() if word.startswith(t)}
    assert kind("frobnik") == {toxicity.INSULT} and kind("zarkle") == {toxicity.THREAT}
    assert kind("wugs") == {toxicity.TARGET} and kind("quoth") == {toxicity.REPORT}


def test_weights_are_where_the_gradient_vanishes():
    model = toxicity._model({})
    texts = ["you idiot", "idiot", "he said you idiot", "", "not an idiot", "I kill you", "word"] * 3
    toxic, weight = np.array([1, 0, 0, 0, 0, 1, 1] * 3), np.linspace(0.5, 2, 21)
    w = toxicity._weights(model, texts, toxic, weight)
    x = np.column_stack((np.ones(len(texts)), np.log1p([walked(t) for t in texts])))

    def loss(v):
        z = x @ v
        prior = np.array([toxicity.BIAS, *(toxicity._prior(*o) for o in toxicity.OUTPUTS)])
        return float(weight @ (np.log1p(np.exp(z)) - toxic * z) + 0.25 * ((v - prior) ** 2).sum())

    for i in range(len(w)):
        for d in (1e-3, -1e-3):
            assert loss(w + d * np.eye(len(w))[i]) > loss(w)


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op3_toxicity(spark, LARGE).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.held_out and r.toxic is not None]
    bad, good = [r.score for r in known if r.toxic == 1], [r.score for r in known if r.toxic == 0]
    assert bad and good
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good])
    assert auc > 0.94 and np.mean([y >= 0.5 for y in good]) < 0.01 and np.mean([x >= 0.5 for x in bad]) > 0.88


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "You idiot"), (3, "You idiot"), (3, "You idiot"), (4, "word " * 100_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = [(r.text, r.score) for r in toxicity.score(docs, model).collect()]
    assert len(got) == 6 and len({s for t, s in got if t == "You idiot"}) == 1
    assert len({s for t, s in got if not t or t.startswith("word")}) == 1
    assert toxicity.fit(docs.limit(0), labels.limit(0)).weights.tolist()[0] == toxicity.BIAS
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_conflicting_labels_repeated_ids_and_the_byte_bound(spark):
    """A repeated id with both labels is toxic and brings one text; texts beyond the bound stay out, whole."""
    docs = spark.createDataFrame([(1, "You idiot")] * 50 + [(2, "fine"), (3, "long " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    once = toxicity.fit(docs, labels, sample_bytes=1000)
    single = toxicity.fit(docs.dropDuplicates().where("doc_id < 3"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert once.weights.tolist() == single.weights.tolist()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("size", F.lit("extra"))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_join", "mixing", "bpe"]
    whole = lambda df: sorted(map(tuple, df.collect()), key=repr)

    first = stages["toxicity"](spark, docs, SMALL).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert first.columns == columns
    assert whole(first) == sorted((tuple(r) for r in docs.collect() if model.scores([r.text or ""])[0] < 0.5), key=repr)

    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for r in first.collect():
        last[low(r.text)] = max(last.get(low(r.text), r.doc_id), r.doc_id)
    second = stages["exact_dedup"](spark, first, SMALL).cache()
    assert second.columns == columns
    assert sorted(r.doc_id for r in second.collect()) == sorted(last.values())

    least = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in second.collect()], 5, 8, 10)}
    third = stages["ngram_join"](spark, second, SMALL).cache()
    assert third.columns == columns
    assert sorted(r.doc_id for r in third.collect()) == sorted(d for d, c in least.items() if d == c)

    fourth = stages["mixing"](spark, third, SMALL).cache()
    assert fourth.columns == columns
    words = {r.doc_id: (r.source, len((r.text or "").split())) for r in third.collect()}
    sizes, taken = Counter(), Counter()
    for source, n in words.values():
        sizes[source] += n
    for r in fourth.collect():
        taken[r.source] += words[r.doc_id][1]
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(sizes), strict=False))
    target, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}:
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    longest = max(n for _, n in words.values())
    for s, t in target.items():
        assert round(t) <= taken[s] <= t + longest
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= 2

    library = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in third.collect()}
    last_stage = stages["bpe"](spark, fourth, SMALL).collect()
    assert len(last_stage) == fourth.count()
    for r in last_stage:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
