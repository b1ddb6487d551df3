"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigspark.llm.ann_tree import ann_query
from sigspark.llm.common import table
from sigspark.llm.cosine_lsh import cosine_query
from sigspark.llm.filter_audit import AUDIT_SQL, audit_query
from sigspark.llm.hard_negatives import NEGATIVES_SQL, negatives_query
from sigspark.llm.huffman import huffman_query
from sigspark.llm.line_dedup import line_query
from sigspark.llm.mixing import mixing_query
from sigspark.llm.packing import packing_query
from sigspark.llm.quality_crf import quality_query
from sigspark.llm.secret_dfa import secrets_query
from sigspark.llm.simhash import simhash_query
from sigspark.llm.toxicity import toxicity_query
from sigspark.llm.window_packing import windows_query
from sigspark.session import ship_package


def _of(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(*[table(spark, sf_dir, name) for name in tables])

    return run


QUERIES = {
    "op1_quality_crf": _of(quality_query, "documents", "labels"),
    "op2_secret_dfa": _of(secrets_query, "documents"),
    "op3_ann_tree": _of(ann_query, "embeddings"),
    "op4_cosine_lsh": _of(cosine_query, "embeddings"),
    "op5_toxicity": _of(toxicity_query, "documents", "labels"),
    "op6_simhash": _of(simhash_query, "documents"),
    "op7_mixing": _of(mixing_query, "documents"),
    "op8_packing": _of(packing_query, "documents"),
    "op9_huffman": _of(huffman_query, "documents"),
    "op10_line_dedup": _of(line_query, "documents"),
    "op11_hard_negatives": _of(negatives_query, "embeddings"),
    "op12_window_packing": _of(windows_query, "documents"),
    "op13_filter_audit": _of(audit_query, "documents", "labels"),
}

#: The others cannot be stated in SQL over whole tables; tests/llm holds them against brute force and round trips.
ORACLES: dict[str, str] = {"op11_hard_negatives": NEGATIVES_SQL, "op13_filter_audit": AUDIT_SQL}
