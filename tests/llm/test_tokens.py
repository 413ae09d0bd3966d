"""BPE, token files and span helpers against the library."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sextant.llm import spans
from pyspark.sql import functions as F

from sextant.llm.bpe import decode, encode, ids_sha256, loaded, tokenizer_path
from sextant.llm.token_files import read_tokens, with_crc32, write_tokens

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
CASES = [
    "", " ", "  ", "\n", "a", "don't stop", "''s it's 'twas I'LL they'll we've 'd", "a  b   c \n d\t\te\n\n", "é̀ ñandú 東京 😀😀 x", "1234 56,78 ½ ²",
    "<|endoftext|>", "x<|endoftext|> <|endoftext|>y  ", "  x 　", "a" * 3000, "ab\r\n" * 50, "!!! %%% $$$ 's", "Ünï'tre", "x'", "'", "' s", "\x1c\x1d a\x85b",
]


@pytest.mark.parametrize("forced", [True, False])
def test_same_ids_and_texts_as_the_library(forced):
    for text, ids in zip(CASES, loaded(PATH).encode(CASES, forced), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)
        assert loaded(PATH).decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab 'stre\nvl1é! 東😀\t")), max_size=40), max_size=6))
def test_any_texts(texts):
    for text, ids in zip(texts, loaded(PATH).encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_pieces_are_those_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    codes, starts = spans.code_points(CASES)
    mask = spans.token_starts(codes, spans.classes()[codes])
    for i, text in enumerate(CASES):
        if "\x1c" in text:
            continue  # the regex module counts these as white space
        at = np.flatnonzero(mask[starts[i] : starts[i + 1]])
        assert [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == pattern.findall(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(spans, "REMEMBERED", 10)
    kept = spans.Remembered()
    for k in range(5):
        hashed = np.arange(20 * k, 20 * k + 20, dtype=np.uint64)
        ids, sizes = kept.expand(kept.find(hashed, lambda new: [[int(i), 1] for i in new]))
        assert sizes.tolist() == [2] * 20 and ids[::2].tolist() == list(range(20))


def test_queries_of_nulls_repeats_and_empty_tables(spark):
    rows = [(2, "b c"), (1, None), (None, "x"), (2, "b c"), (7, "<|endoftext|>"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS decoded")
    tokens = decode(encode(docs, PATH), PATH)
    assert tokens.columns == ["doc_id", "ids", "decoded"]
    got = tokens.select("*", F.size("ids").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")).collect()
    assert len(got) == 6
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert decode(encode(docs.limit(0), PATH), PATH).count() == 0
    summed = decode(encode(docs, PATH), PATH, sha_col="sha").select("sha", ids_sha256("ids").alias("again")).collect()
    assert len(summed) == 6 and all(r.sha == r.again for r in summed)


def test_files_keep_order_starts_and_sums(spark, tmp_path):
    rows = [(i * 7 % 101, "word " * (i % 13) + str(i)) for i in range(101)] + [(None, "n"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    write_tokens(docs, f"file://{tmp_path}/t", PATH)
    got = sorted(with_crc32(read_tokens(spark, f"file://{tmp_path}/t")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    start = 0
    for (_, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0])), got, strict=True):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert read_tokens(spark, f"file://{tmp_path}/t", with_ids=False).columns == ["doc_id", "start", "n_tokens"]
    write_tokens(docs.limit(0), f"file://{tmp_path}/e", PATH)
    assert read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_layout_of_the_files_lets_readers_select(spark, tmp_path):
    """Delta-coded addresses, dictionary-coded ids, page indexes; and columns of other names are not written."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 20, i, "x") for i in range(5000)], "doc_id long, text string, n_tokens int, part string")
    write_tokens(docs, f"file://{tmp_path}/t", PATH)
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    footers = [pq.ParquetFile(x).metadata for x in files]
    assert sum(m.num_rows for m in footers) == 5000
    for m in footers:
        for g in range(m.num_row_groups):
            columns = {m.row_group(g).column(i).path_in_schema.split(".")[0]: m.row_group(g).column(i) for i in range(m.num_columns)}
            assert set(columns) == {"part", "doc_id", "offset", "n_tokens", "ids"}
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "offset", "n_tokens"))
            assert any("DICTIONARY" in e for e in columns["ids"].encodings)
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    narrow = read_tokens(spark, f"file://{tmp_path}/t", with_ids=False)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    picked = read_tokens(spark, f"file://{tmp_path}/t").where("doc_id BETWEEN 40 AND 41")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,40)" in picked._jdf.queryExecution().executedPlan().toString() and picked.count() == 2
