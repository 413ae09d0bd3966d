"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public
vocabulary. The probability of a word is the sum over all ways to cut it
into pieces, found by the forward algorithm; a text's is that of its words.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import stage, unstage, unused
from .spans import Prefixes, Remembered, chunks, classes, code_points, hashes, lowered, word_spans

#: Learned documents looked at for each language, and rounds of expectation maximisation.
SAMPLE, ROUNDS = 400, 2
#: Marks the start of a word.
START = "▁"
#: Probability of a letter that is no piece of the vocabulary, and what smooths the counts.
UNKNOWN, SMOOTH = 1e-6, 0.1


def vocabulary(path: str) -> list[str]:
    """Lower-cased pieces of letters only, with or without word start, from a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        body = piece.removeprefix(START)
        if all(unicodedata.category(c)[0] == "L" for c in body) and body.count(START) == 0 and piece:
            found.add(piece)
    return sorted(found)


class Pieces:
    """The vocabulary as a hash table over code points."""

    BITS = 20

    def __init__(self, pieces: list[str]) -> None:
        codes, starts = code_points(pieces)
        self.hashes = hashes(codes, starts[:-1], starts[1:] - 1)
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        slots = (self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.table[slots] = np.arange(len(pieces))
        many = np.bincount(slots, minlength=1 << self.BITS)
        self.table[many > 1] = -2  # looked up in order
        self.lengths = sorted(set(map(len, pieces)) | {1})
        self.longest = self.lengths[-1]

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        found = self.table[(hashed >> np.uint64(64 - self.BITS)).astype(np.int64)]
        shared = np.flatnonzero(found == -2)
        if len(shared):
            spot = np.minimum(np.searchsorted(self.sorted, hashed[shared]), len(self.sorted) - 1)
            found[shared] = self.order[spot]
        found[(found >= 0) & (self.hashes[np.maximum(found, 0)] != hashed)] = -1
        return found

    def arcs(self, words: list[str]) -> Arcs:
        """Every way to end a piece, or a letter that is none, at every letter of every word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(1, len(codes) + 1) - (np.cumsum(sizes) - sizes)[word]
        hashed = Prefixes(codes)
        found = []
        for n in self.lengths:
            end = np.flatnonzero(place >= n) + 1
            piece = self.find(hashed.of(end - n, end))
            if n == 1:
                piece = np.where(piece < 0, len(self.hashes), piece)  # the last number: unknown
            end, piece = end[piece >= 0], piece[piece >= 0]
            found.append((end, np.full(len(end), n), piece))
        end, length, piece = map(np.concatenate, zip(*found, strict=True))
        last = np.cumsum(sizes + 1) - 1  # a word has a state before each letter and one after the last
        return Arcs(end + word[end - 1], length, piece, place[end - 1], sizes[word[end - 1]], last)


@dataclass(frozen=True)
class Arcs:
    """Arcs of many words, whose states are numbered one after another: the state an
    arc ends in, its length and piece, its end's place in the word, the word's size;
    and each word's last state."""

    to: np.ndarray
    length: np.ndarray
    piece: np.ndarray
    place: np.ndarray
    size: np.ndarray
    last: np.ndarray

    def sums(self, prob: np.ndarray, backward: bool = False) -> np.ndarray:
        """Log of the sum over all ways from a word's first state to each state, or
        from there to its last: states x languages. ``prob`` is pieces x languages,
        unknown letters last. Each state is counted from its neighbour's scale, so
        that words of any length stay in range."""
        start = self.to - self.length
        node, other, near = (start, self.to, start + 1) if backward else (self.to, start, self.to - 1)
        step = self.size - self.place + self.length if backward else self.place
        order = np.lexsort((self.length, node, step))
        node, other, near, piece = (x[order] for x in (node, other, near, self.piece))
        heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(step[order][heads]) > 0)))
        logs = np.zeros((self.last[-1] + 1, prob.shape[1]))
        for a, b in zip(bounds, np.append(bounds[1:], len(heads)), strict=True):
            first, end = heads[a], heads[b] if b < len(heads) else len(node)
            here = slice(first, end)
            terms = np.exp(logs[other[here]] - logs[near[here]]) * prob[piece[here]]
            own = heads[a:b]
            logs[node[own]] = logs[near[own]] + np.log(np.add.reduceat(terms, own - first, axis=0))
        return logs


def _known(prob: np.ndarray) -> np.ndarray:
    return np.vstack((prob, np.full((1, prob.shape[1]), UNKNOWN)))


def word_logs(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: the sum over all its
    segmentations, whatever its length. ``prob`` is pieces x languages."""
    prob, found = _known(prob), [np.zeros((0, prob.shape[1]))]
    for part in chunks(words):
        arcs = pieces.arcs(part)
        found.append(arcs.sums(prob)[arcs.last])
    return np.concatenate(found)


def _expected(words: list[str], counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of counted words, one language."""
    total, prob, at = np.zeros(len(prob) + 1), _known(prob[:, None]), 0
    for part in chunks(words):
        arcs = pieces.arcs(part)
        ahead, back = arcs.sums(prob)[:, 0], arcs.sums(prob, backward=True)[:, 0]
        word = np.searchsorted(arcs.last, arcs.to)
        share = np.exp(ahead[arcs.to - arcs.length] + back[arcs.to] - ahead[arcs.last[word]]) * prob[arcs.piece, 0]
        total += np.bincount(arcs.piece, share * counts[at + word], len(total))
        at += len(part)
    return total[:-1]


def _words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased code points of a chunk, its words' spans, and the text of each word."""
    at = 0
    for part in chunks(texts):
        codes, starts = code_points(part)
        first, last = word_spans(classes()[codes])
        yield lowered()[codes], first, last, at + np.searchsorted(starts, first, side="right") - 1
        at += len(part)


def _strings(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    return [START + low[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(first, last, strict=True)]


class Model:
    def __init__(self, languages: list[str], pieces: list[str], prob: np.ndarray) -> None:
        self.languages, self.pieces, self.prob = languages, pieces, prob
        self.ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ready": None}

    def logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probability of each text in each language, and its number of words."""
        if self.ready is None:
            self.ready = Pieces(self.pieces), Remembered(np.float64)
        pieces, kept = self.ready
        k = len(self.languages)
        total, words = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for low, first, last, text in _words(texts):
            if not len(first):
                continue
            slots = kept.find(hashes(low, first, last), lambda new, s=(low, first, last): list(word_logs(_strings(s[0], s[1][new], s[2][new]), pieces, self.prob)))
            each = kept.expand(slots)[0].reshape(-1, k)
            for j in range(k):
                total[:, j] += np.bincount(text, each[:, j], len(texts))
            words += np.bincount(text, minlength=len(texts))
        return total, words

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language (``und`` without letters) and its posterior under equal priors.

        Ties go to the first in code point order."""
        if not self.languages:
            return np.full(len(texts), "und", object), np.zeros(len(texts))
        logs, words = self.logs(texts)
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(words > 0, np.array(self.languages, object)[best], "und"), np.where(words > 0, score, 0.0)


def fit(docs: DataFrame, pieces: list[str], sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn piece probabilities from ``docs(doc_id, text, lang)``.

    About ``sample`` documents of each language are looked at, drawn by a hash
    of the id. Their words are counted in Spark; every round adds up expected
    piece counts there, so the driver sees only pieces x languages. Null
    languages, texts and ids teach nothing; without any, as in an empty table,
    there is no language. Repeated rows teach as often as they occur; other
    columns are not looked at.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count()
    share = F.col("count").cast("double")
    drawn = known.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003)) * share < sample * 1_000_003)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tally: Counter = Counter()
            langs = batch["lang"].to_numpy()
            for low, first, last, text in _words(batch["text"].tolist()):
                tally.update(zip(langs[text], _strings(low, first, last), strict=True))
            yield pd.DataFrame([(*k, v) for k, v in tally.items()], columns=["lang", "word", "n"])

    words, path = stage(drawn.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted((r["lang"] for r in words.select("lang").distinct().collect()), key=lambda x: x.encode())
    prob = np.full((len(pieces), len(languages)), 1 / max(1, len(pieces)))
    for _ in range(rounds if languages else 0):

        def expect(batches: Iterator[pd.DataFrame], prob: np.ndarray = prob) -> Iterator[pd.DataFrame]:
            table = Pieces(pieces)
            total = np.zeros(prob.shape)
            for batch in batches:
                for lang, part in batch.groupby("lang"):
                    j = languages.index(lang)
                    total[:, j] += _expected(part["word"].tolist(), part["n"].to_numpy(np.float64), table, prob[:, j])
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        rows = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        prob = np.full(prob.shape, SMOOTH)
        prob[rows["piece"], rows["lang"]] += rows["n"]
        prob /= prob.sum(axis=0)
    unstage(docs.sparkSession, path)
    return Model(languages, pieces, prob)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred, score`` to every row of ``docs`` from its whole ``text``.

    ``und`` with score 0 if the text is null or has no letter, and everywhere if
    the model has no language. Texts and words of any length are scored whole.
    Columns of ``docs`` called like the added ones are replaced; repeated rows
    get the same; an empty table gives an empty one.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = model.predict([x if isinstance(x, str) else "" for x in texts])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    docs = docs.drop(*(c for c in ("lang_pred", "score") if c in docs.columns))
    found = unused("predicted", docs.columns)
    return docs.withColumn(found, predicted("text")).select(*docs.columns, f"{found}.lang_pred", f"{found}.score")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``; null and letterless texts are ``und``
    with score 0. Three of four ids by crc32 teach, if they name a language; see ``fit`` and ``identify``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()), vocabulary(tokenizer_path("piece_bpe_32k.model")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
