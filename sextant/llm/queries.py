"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .bpe import op7_bpe
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .langid import op2_langid
from .manifest import OP12_SQL, op12_manifest
from .mixing import OP9_SQL, op9_mixing
from .ngram_join import op5_ngram_join
from .repair import OP11_SQL, op11_repair
from .token_files import op6_token_files
from .topk import OP13_SQL, op13_topk
from .toxicity import op3_toxicity
from .url_filter import OP1_SQL, op1_url_filters
from .vector_join import OP4_SQL, op4_vector_join
from .warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filters, op2_langid, op3_toxicity, op4_vector_join, op5_ngram_join, op6_token_files, op7_bpe, op8_warc, op9_mixing, op10_exact_dedup, op11_repair, op12_manifest, op13_topk]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op1_url_filters": OP1_SQL, "op4_vector_join": OP4_SQL, "op8_warc": OP8_SQL, "op9_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_repair": OP11_SQL, "op12_manifest": OP12_SQL, "op13_topk": OP13_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
