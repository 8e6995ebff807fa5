"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import op5_embedding_dedup
from .importance import op13_importance
from .language_id import op9_language_id
from .line_dedup import op7_line_dedup
from .mixing import OP10_SQL, op10_mixing
from .packing import op2_packing
from .secrets import op3_secret_scan
from .simhash import op4_simhash
from .substring_dedup import op1_substring_dedup
from .token_files import op6_token_files
from .topk import OP8_SQL, op8_topk
from .toxicity import op11_toxicity
from .trie import OP12_SQL, op12_conversation_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_simhash": op4_simhash,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_topk": op8_topk,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_importance": op13_importance,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {"op8_topk": OP8_SQL, "op10_mixing": OP10_SQL, "op12_conversation_trie": OP12_SQL}
