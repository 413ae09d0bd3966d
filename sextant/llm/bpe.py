"""BPE encoding and decoding with forced-boundary splitting.

Two bytes that never stand next to each other inside a token of the
vocabulary are always cut. Texts split at these pairs and at the
pre-tokenizer's pieces; every distinct fragment is encoded once, and the ids
of a text are those of its fragments one after another.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import Remembered, chunks, classes, code_points, hashes, token_starts

#: Tokens after which a batch of rows is handed on.
FLUSH = 500_000


@cache
def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the code points
    from 256 on, in order.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@cache
def token_table(path: str) -> tuple[dict[int, bytes], dict[str, int]]:
    """The bytes of each plain token by id, and the ids of special tokens: all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
        raise ValueError("a byte-level BPE without normalizer is needed")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    back = {c: b for b, c in byte_letters().items()}
    return {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}, special


def joined(ids: np.ndarray, path: str) -> str:
    """As the library's ``decode(ids, skip_special_tokens=False)``, without the library."""
    plain, special = token_table(path)
    named = {i: t.encode() for t, i in special.items()}
    return b"".join(plain[i] if i in plain else named[i] for i in ids.tolist()).decode("utf-8", "replace")


class ByteBpe:
    """A byte-level BPE of a ``tokenizer.json`` file, as arrays."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path, self.letters = path, byte_letters()
        plain, self.special = token_table(path)
        self.never = np.ones((256, 256), bool)
        for token in plain.values():
            self.never[list(token[:-1]), list(token[1:])] = False
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kept = Remembered()

    def _tokens(self, fragment: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.letters))]

    def _plain(self, texts: list[str], forced: bool) -> Iterator[np.ndarray]:
        """Ids of texts without special tokens."""
        codes, text_starts = code_points(texts)
        starts = token_starts(codes, classes()[codes])
        widths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        widths[text_starts[1:] - 1] = 0
        at = np.concatenate(([0], np.cumsum(widths)))
        data = "".join(texts).encode()
        raw = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(raw) + 1, bool)
        cut[at[:-1][starts]] = True
        if forced and len(raw):
            cut[1:-1] |= self.never[raw[:-1], raw[1:]]
        begins = np.flatnonzero(cut[:-1])
        ends = np.append(begins[1:], len(raw))
        slots = self.kept.find(hashes(raw, begins, ends), lambda new: [self._tokens(data[begins[i] : ends[i]]) for i in new]) if len(begins) else np.zeros(0, np.int64)
        ids, sizes = self.kept.expand(slots)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(begins, at[text_starts])]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]

    def encode(self, texts: list[str], forced: bool = True) -> Iterator[np.ndarray]:
        """Ids of each text, as the library's ``encode(text, add_special_tokens=False)``.

        A special token's string in a text is that token's id."""
        for part in chunks(texts):
            odd = {i for i, t in enumerate(part) if any(s in t for s in self.special)}
            plain = self._plain([t for i, t in enumerate(part) if i not in odd], forced)
            for i, text in enumerate(part):
                yield self._mixed(text, forced) if i in odd else next(plain)

    def _mixed(self, text: str, forced: bool) -> np.ndarray:
        pieces: list[str | int] = [text]
        for content, i in self.special.items():
            pieces = [y for x in pieces for y in (_between(x, content, i) if isinstance(x, str) else [x])]
        return np.concatenate([np.zeros(0, np.int32), *(next(self._plain([p], forced)) if isinstance(p, str) else np.array([p], np.int32) for p in pieces)])

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``."""
        return joined(ids, self.path)


def _between(text: str, content: str, i: int) -> list[str | int]:
    found: list[str | int] = []
    for k, part in enumerate(text.split(content)):
        found += [i] * (k > 0) + [part]
    return found


@cache
def loaded(path: str) -> ByteBpe:
    """One for each worker, which serves all its tasks."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace the text of every row of ``docs`` by its ids, an ``array<int>``.

    Null text is encoded as empty, texts of any length whole; other columns
    stay, one called like ``ids_col`` is replaced. Every row gives a row, ids of
    rows may be null or repeat; an empty table gives an empty one. ``path``: the tokenizer file, at the same place on every executor.
    """
    docs = docs.drop(*(c for c in docs.columns if c == ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            rest = batch.select(kept)
            first, held, size = 0, [], 0
            for i, ids in enumerate(bpe.encode(texts)):
                held.append(ids)
                size += len(ids)
                if i + 1 == len(texts) or size > FLUSH:
                    yield _with(rest.slice(first, len(held)), ids_col, lists(held))
                    first, held, size = i + 1, [], 0

    kept = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", sha_col: str | None = None) -> DataFrame:
    """Add the text that the ids of every row stand for; null ids give empty text.

    ``sha_col``: also add the SHA-256 of the ids under this name, while they
    are at hand. Columns called like the added ones are replaced."""
    tokens = tokens.drop(*(c for c in tokens.columns if c in (text_col, sha_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids = list(each(part.column(ids_col)))
                part = _with(part, text_col, pa.array([joined(x, path) for x in ids], pa.string()))
                yield part if sha_col is None else _with(part, sha_col, pa.array(map(_sha256, ids), pa.string()))

    added = [T.StructField(c, T.StringType()) for c in (text_col, sha_col) if c is not None]
    return tokens.mapInArrow(run, T.StructType([*tokens.schema, *added]))


def _sha256(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32)))


def each(column: pa.ListArray) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield values[a:b]


@F.pandas_udf(T.StringType())
def ids_sha256(ids: pd.Series) -> pd.Series:
    """Of ids as little-endian unsigned 32-bit integers, lower-case hex."""
    return ids.map(_sha256)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text of ``documents``, encoded and decoded again; null texts are empty
    and have no ids; see ``encode`` and ``decode``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = decode(encode(docs, tokenizer_path()), tokenizer_path(), sha_col="ids_sha256")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
