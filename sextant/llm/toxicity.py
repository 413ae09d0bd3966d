"""Toxicity: a weighted finite-state grammar over clauses.

Small transducers read a text as symbols: insults, threats, targets, negation,
reporting words, quotation marks and the marks that end clauses. Composed they
are two machines, one reading from the left and one from the right, so that an
attack is judged by what stands before and after it: each insult or threat gives
one output saying whether it is aimed at someone, negated, or only reported. A
document's score weighs the outputs of its clauses. Weights, and forms beyond
the built-in words, are learned from labels.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, unstage
from .spans import SEPARATOR, Prefixes, chunks, classes, code_points, hashes, lowered, word_spans

#: Labelled documents that the fit looks at, for each label, and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 20
#: Texts, and share of the toxic sample, that a learned form must newly cover; how often more frequent it must be there,
#: and from where on it weighs as much as a built-in word.
LEAST_TEXTS, LEAST_GAIN, LEAST_RATIO, FULL_RATIO = 4, 0.01, 4.0, 100.0
#: Toxic and clean texts with attacks that targets and reporting words are learned from at least; standard errors by which
#: such a word must differ between both, and the log likelihood it must gain.
LEAST_ATTACKED, LEAST_ERRORS, LEAST_LIKELIHOOD = 20, 4.0, 5.0
#: How much more a toxic document of the sample weighs than a clean one, beyond their shares.
TOXIC_COST = 2.0
#: Lengths of learned stems; a stem stands for all words that begin with it.
STEMS = (4, 5, 6, 7, 8)

INSULT, THREAT, TARGET, NEGATION, REPORT, PLAIN, QUOTE, CLAUSE, SENTENCE, LINE = SYMBOLS = range(10)
WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage clown clowns pathetic worthless disgusting vermin "
    "imbecile imbécile crétin abruti connard ordure dummkopf trottel arschloch abschaum versager estúpido imbécil basura escoria inútil",
    THREAT: "kill hurt destroy punch stab shoot burn beat tuer frapper détruire töten schlagen vernichten umbringen matar golpear destruir",
    TARGET: "you your yours u he she they them him her tu toi te vous ils elle elles il du dich dir ihr sie er usted ustedes ellos ella él",
    NEGATION: "not no never don doesn didn isn aren wasn weren won couldn wouldn shouldn mustn needn haven hasn hadn ain dont doesnt didnt isnt arent wont cant couldnt wouldnt shouldnt cannot without pas jamais ne nicht kein keine nie nunca jamás sin ni",
    REPORT: "said says say called calls wrote writes claimed according quoted reported dit disait selon sagte sagt laut schrieb dijo dice según escribió",
}
#: What ends a line, a sentence or a clause, and what opens or closes a quotation.
MARKS = {LINE: "\n", SENTENCE: ".!?", CLAUSE: ";:", QUOTE: "\"“”„«»"}
ENDS = (CLAUSE, SENTENCE, LINE)
#: Words over which a negation, a target and a reporting word reach what follows (left) or precedes (right) them.
LEFT_REACH = {TARGET: 6, NEGATION: 3}
#: A threat is aimed at its object: a target right before it, or soon after it.
OBJECT_REACH = 1
RIGHT_REACH = {TARGET: 3, NEGATION: 2, REPORT: 3}

#: Outputs of the composed machines, with the weight that each has unless labels say otherwise.
OUTPUTS = [(kind, aimed, negated, reported) for kind in (INSULT, THREAT) for aimed in (0, 1) for negated in (0, 1) for reported in (0, 1)]
BIAS = -3.0


def _prior(kind: int, aimed: int, negated: int, reported: int) -> float:
    return (2.5 + 2.5 * aimed if kind == INSULT else 5.0 * aimed) * (0.3 if negated else 1) * (0.3 if reported else 1)


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, symbol) -> (state, output)``; state 0 starts every line."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = field(repr=False)

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols in step; outputs are joined. Only reachable states are made."""
        names, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for symbol in SYMBOLS:
                (a, x), (b, y) = self.arcs[pair[0], symbol], other.arcs[pair[1], symbol]
                if (a, b) not in names:
                    names[a, b] = len(names)
                    todo.append((a, b))
                arcs[names[pair], symbol] = (names[a, b], x + y)
        return Transducer(len(names), arcs)


def _within(trigger: int, reach: int, ends: Sequence[int] = ENDS) -> Transducer:
    """Outputs 1 for ``reach`` words after a trigger, up to one of ``ends``; marks are no words."""

    def following(state: int, symbol: int) -> int:
        if symbol == trigger:
            return reach
        return 0 if symbol in ends else state if symbol > PLAIN else max(0, state - 1)

    return Transducer(reach + 1, {(s, x): (following(s, x), (int(s > 0),)) for s in range(reach + 1) for x in SYMBOLS})


def _since(trigger: int, ends: Sequence[int] = (SENTENCE, LINE)) -> Transducer:
    """Outputs 1 after a trigger, up to one of ``ends``."""
    return Transducer(2, {(s, x): (int(x == trigger or s and x not in ends), (s,)) for s in range(2) for x in SYMBOLS})


def _inside(mark: int) -> Transducer:
    """Outputs 1 between a mark and the next one, to the line's end."""
    return Transducer(2, {(s, x): (1 - s if x == mark else 0 if x == LINE else s, (s,)) for s in range(2) for x in SYMBOLS})


def from_left() -> Transducer:
    """Outputs: the symbol; whether a target, a negation and a reporting word precede it; whether it
    is quoted; whether an object stands right before it."""
    attack = Transducer(1, {(0, x): (0, (x,)) for x in SYMBOLS})
    return reduce(Transducer.compose, [attack, *(_within(x, n) for x, n in LEFT_REACH.items()), _since(REPORT), _inside(QUOTE), _within(TARGET, OBJECT_REACH)])


def from_right() -> Transducer:
    """Outputs, reading backwards: whether a target, a negation and a reporting word follow."""
    return reduce(Transducer.compose, [_within(x, n, (SENTENCE, LINE) if x == REPORT else ENDS) for x, n in RIGHT_REACH.items()])


def _joined(left: tuple[int, ...], right: tuple[int, ...]) -> int:
    """The output of both machines at one symbol, or -1 if it is no attack. A
    negation that follows counts for threats only."""
    kind, target, negation, report, quoted, before = left
    target_after, negation_after, report_after = right
    if kind not in (INSULT, THREAT):
        return -1
    return OUTPUTS.index((kind, (before if kind == THREAT else target) | target_after, negation | (negation_after & (kind == THREAT)), report | quoted | report_after))


@cache
def _machines() -> tuple[list, list, list]:
    """Both machines as lists ``state -> symbol -> (state, said)``, and the output by what both said."""
    machines = from_left(), from_right()
    said = [sorted({o for _, o in m.arcs.values()}) for m in machines]
    left, right = ([[(m.arcs[s, x][0], o.index(m.arcs[s, x][1])) for x in SYMBOLS] for s in range(m.states)] for m, o in zip(machines, said, strict=True))
    return left, right, [[_joined(x, y) for y in said[1]] for x in said[0]]


@dataclass
class Model:
    """Symbols and arc weights of lower-cased words and stems, and weights of outputs."""

    words: dict[str, tuple[int, float]]
    stems: dict[str, tuple[int, float]]
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.tables = [(0, *_table(self.words))]
        for n in sorted({len(s) for s in self.stems}):
            self.tables.append((n, *_table({s: v for s, v in self.stems.items() if len(s) == n})))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Arc weights summed by output, for each text."""
        found = np.zeros((len(texts), len(OUTPUTS)))
        at = 0
        for part in chunks(texts):
            codes, starts = code_points(part)
            first, last = word_spans(classes()[codes])
            low = Prefixes(lowered()[codes])
            symbols, arcs = np.full(len(first), PLAIN, np.int8), np.zeros(len(first))
            for n, keys, values, weights in self.tables:
                ends = last if n == 0 else np.minimum(first + n, last)
                hashed = low.of(first, ends)
                spot = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
                hit = (keys[spot] == hashed) & (symbols == PLAIN) if len(keys) else np.zeros(len(first), bool)
                symbols[hit], arcs[hit] = values[spot[hit]], weights[spot[hit]]
            if ((symbols == INSULT) | (symbols == THREAT)).any():
                marks = _marks()[codes]
                place = np.flatnonzero(marks)
                where = np.concatenate((first, place))
                order = np.argsort(where, kind="stable")
                where, arcs = where[order], np.concatenate((arcs, np.zeros(len(place))))[order]
                symbols = np.concatenate((symbols, marks[place]))[order]
                self._read(symbols, arcs, at + np.searchsorted(starts, where, side="right") - 1, found)
            at += len(part)
        return found

    def _read(self, symbols: np.ndarray, arcs: np.ndarray, text: np.ndarray, found: np.ndarray) -> None:
        """Run both machines over the lines that hold an attack."""
        left, right, output = _machines()
        line = np.cumsum(symbols == LINE)
        for c in np.unique(line[(symbols == INSULT) | (symbols == THREAT)]):
            a, b = np.searchsorted(line, [c, c + 1])
            read, row = symbols[a:b].tolist(), found[text[a]] if symbols[a] != LINE else found[text[min(a + 1, b - 1)]]
            state, after = 0, []
            for symbol in reversed(read):
                state, said = right[state][symbol]
                after.append(said)
            state = 0
            for symbol, weight, behind in zip(read, arcs[a:b].tolist(), reversed(after), strict=True):
                state, said = left[state][symbol]
                if (i := output[said][behind]) >= 0:
                    row[i] += weight

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + np.log1p(self.counts(texts)) @ self.weights[1:])))


@cache
def _marks() -> np.ndarray:
    """The symbol of each code point that is a mark; the end of a text ends a line."""
    table = np.zeros(SEPARATOR + 1, np.int8)
    for symbol, characters in MARKS.items():
        table[[ord(c) for c in characters]] = symbol
    table[SEPARATOR] = LINE
    return table


def _table(lexicon: dict[str, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not lexicon:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0)
    codes, starts = code_points(list(lexicon))
    keys = hashes(codes, starts[:-1], starts[1:] - 1)
    order = np.argsort(keys)
    symbols, weights = zip(*lexicon.values(), strict=True)
    return keys[order], np.array(symbols, np.int8)[order], np.array(weights)[order]


def built_in() -> dict[str, tuple[int, float]]:
    return {w: (kind, 1.0) for kind, words in WORDS.items() for w in words.split()}


def _forms(text: str) -> set[tuple[int, str]]:
    """Words (0, word) and stems (length, stem) of a text, lower-cased."""
    codes, _ = code_points([text])
    low = "".join(map(chr, lowered()[codes[:-1]]))
    first, last = word_spans(classes()[codes])
    words = {low[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)}
    return {(0, w) for w in words if len(w) > 3} | {(n, w[:n]) for w in words for n in STEMS if len(w) > n}


Forms = dict[tuple[int, str], tuple[int, float]]


def _model(forms: Forms, weights: np.ndarray | None = None) -> Model:
    """The built-in words with learned words ``(0, word)`` and stems ``(length, stem)``."""
    words, stems = ({t: v for (n, t), v in forms.items() if (n > 0) == stem} for stem in (False, True))
    return Model(words | built_in(), stems, np.array([BIAS, *(_prior(*o) for o in OUTPUTS)]) if weights is None else weights)


def _likelihood(forms: Forms, texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(_model(forms).scores(texts), 1e-9, 1 - 1e-9)
    return float(weight @ np.where(toxic == 1, np.log(p), np.log(1 - p)))


def _learned(texts: list[str], toxic: np.ndarray) -> Forms:
    """Words and stems that mark toxic texts, with arc weights by how often more
    frequent they are there; then words that mark what attacks mean.

    Forms are taken greedily by weight and by how many toxic texts they cover
    that fewer than two taken or built-in forms cover; of stems that cover
    nearly the same, the longest. Each is an insult, or a threat, which counts
    only where it is aimed: whichever makes the labels likelier. Of texts with
    attacks, forms that are more frequent in toxic or in clean ones become
    targets or reporting words if the labels gain enough likelihood by it.
    Texts that share their rarest long word are
    likely copies of each other and count as one text together.
    """
    number: dict[tuple[int, str], int] = {}  # forms are held once and told by number: the sample's sets stay small
    sets = [np.fromiter((number.setdefault(f, len(number)) for f in _forms(t)), np.int64) for t in texts]
    listed = list(number)
    having = lambda j, among: np.array([i for i in among if (sets[i] == j).any()], np.int64)
    seen = np.bincount(np.concatenate(sets), minlength=len(listed))
    mark = [min(((seen[j], listed[j]) for j in s if listed[j][0] == 0 and len(listed[j][1]) > 7), default=(0, (0, ""))) for s in sets]
    mark = [m[1] if m[0] > 1 else (0, str(i)) for i, m in enumerate(mark)]
    same = Counter(mark)
    weight = np.array([1 / same[m] for m in mark])
    mass = {y: max(1e-9, weight[toxic == y].sum()) for y in (0, 1)}
    by_form: dict[int, list[int]] = defaultdict(list)
    clean = np.zeros(len(listed))
    for i, s in enumerate(sets):
        if toxic[i]:
            for j in s.tolist():
                by_form[j].append(i)
        else:
            clean[s] += weight[i]
    least = max(LEAST_TEXTS, LEAST_GAIN * mass[1])
    own = {(0, w) for w, (kind, _) in built_in().items() if kind == INSULT}
    ours = [number[f] for f in own if f in number]
    need = np.array([max(0, 2 - int(np.isin(ours, s).sum())) for s in sets])
    arc, docs_of = {}, {}
    for j, docs in by_form.items():
        f = listed[j]
        if (w := weight[docs].sum()) >= least and (ratio := (w / mass[1]) / ((clean[j] + 0.5) / mass[0])) >= LEAST_RATIO and not any(w.startswith(f[1]) for _, w in own):
            arc[f], docs_of[f] = min(1.0, float(np.log(ratio) / np.log(FULL_RATIO))), np.array(docs)
    gain = lambda f: arc[f] * float(weight[docs_of[f]] @ (need[docs_of[f]] > 0))
    related = lambda f, g: f == g or f[1].startswith(g[1]) and g[0] > 0 or g[1].startswith(f[1]) and f[0] > 0
    taken: dict[tuple[int, str], float] = {}
    while arc:
        gains = {f: gain(f) for f in arc}
        best = max(gains, key=lambda f: (round(gains[f], 9), f))
        if gains[best] < least:
            break
        best = max((f for f in arc if related(f, best) and gains[f] >= 0.95 * gains[best]), key=lambda f: (f[0] > 0, len(f[1]), gains[f], f))
        taken[best] = arc[best]
        need[docs_of[best]] -= 1
        arc = {f: a for f, a in arc.items() if not related(f, best)}
    forms: Forms = {f: (INSULT, a) for f, a in taken.items()}
    for f, a in taken.items():
        rows = having(number[f], range(len(texts)))
        some = [texts[i] for i in rows]
        forms[f] = max(((kind, a) for kind in (INSULT, THREAT)), key=lambda v: _likelihood(forms | {f: v}, some, toxic[rows], weight[rows]))
    attacked = np.flatnonzero(_model(forms).counts(texts).sum(axis=1) > 0)
    mass = {y: weight[attacked][toxic[attacked] == y].sum() for y in (0, 1)}
    if min(mass.values()) < LEAST_ATTACKED:
        return forms
    near = np.zeros((2, len(number)))
    for i in attacked:
        near[toxic[i], sets[i]] += weight[i]
    for y, kind in ((1, TARGET), (0, REPORT)):
        here, there = near[y] / mass[y], near[1 - y] / mass[1 - y]
        p = np.clip(near.sum(axis=0) / (mass[0] + mass[1]), 1e-9, 1 - 1e-9)
        clear = here - there >= LEAST_ERRORS * np.sqrt(p * (1 - p) * (1 / mass[0] + 1 / mass[1]))
        for j in sorted(np.flatnonzero((near[y] >= LEAST_TEXTS) & clear), key=lambda j: (-near[y, j], listed[j])):
            f = listed[j]
            if f[0] or f in forms or f[1] in built_in():
                continue
            rows = having(j, attacked)
            some = [texts[i] for i in rows]
            gain = _likelihood(forms | {f: (kind, 1.0)}, some, toxic[rows], weight[rows]) - _likelihood(forms, some, toxic[rows], weight[rows])
            if gain >= LEAST_LIKELIHOOD:
                forms[f] = (kind, 1.0)
    return forms


def _weights(model: Model, texts: list[str], toxic: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps; a ridge holds them near the priors."""
    prior = np.array([BIAS, *(_prior(*o) for o in OUTPUTS)])
    x = np.column_stack((np.ones(len(texts)), np.log1p(model.counts(texts))))
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (importance * (p - toxic)) + 0.5 * (w - prior)
        hessian = (x * (importance * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from ``labels(doc_id, toxic)`` joined to ``docs(doc_id, text)``.

    At most about ``sample`` documents of each label are looked at, drawn by
    a hash of the id, and of these as many whole texts as ``sample_bytes``
    hold, the longest staying out: bounds on what reaches the driver, whatever the
    input. An id with both labels counts as toxic, of an id with several texts
    the last in order is taken, so that reruns learn the same. Null ids,
    labels and texts teach nothing. Without labels, or in an empty table, the
    built-in words and prior weights are the model.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, sample / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003))
    drawn = known.where(place < share * 1_000_003)
    got = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    got, path = stage(got.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "toxicity-sample")
    before = Window.orderBy(F.octet_length("text"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's ids and sizes
    room = got.select("doc_id", F.sum(F.octet_length("text")).over(before).alias("bytes")).where(F.col("bytes") <= sample_bytes)
    rows = got.join(F.broadcast(room.select("doc_id")), "doc_id").toPandas().sort_values("doc_id")
    unstage(docs.sparkSession, path)
    texts, toxic = rows["text"].tolist(), rows["toxic"].to_numpy()
    model = _model(_learned(texts, toxic) if len(set(toxic)) == 2 else {})
    if len(texts):
        importance = np.array([max(1.0, counts.get(int(y), 1) / sample) * (TOXIC_COST if y else 1) for y in toxic])
        model.weights = _weights(model, texts, toxic, importance / importance.mean())
    return model


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1) to every row of ``docs``, from the whole ``text``.

    Null and empty texts have no clause and get the score of no match; texts
    of any length are read whole. A column of that name is replaced; repeated
    rows are scored alike; an empty table gives an empty one.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([x if isinstance(x, str) else "" for x in texts]))

    return docs.withColumn(out, scored("text"))


def held_out(doc_id: str = "doc_id"):
    """Documents whose labels are not learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text of ``documents``; null and empty texts get the
    score of no match, repeated rows the same one. Four of five ids by crc32 teach; see ``fit`` and ``score``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
