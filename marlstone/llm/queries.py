"""Queries of the operators, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_bpe, op2_sst, op3_graph, op4_viterbi, op5_spans, op6_lines, op7_packing, op8_quality, op9_topk, op10_simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe.op1_bpe,
    "op2_token_files": op2_sst.op2_token_files,
    "op3_graph_search": op3_graph.op3_graph_search,
    "op4_token_counts": op4_viterbi.op4_token_counts,
    "op5_sentence_spans": op5_spans.op5_sentence_spans,
    "op6_line_dedup": op6_lines.op6_line_dedup,
    "op7_packing": op7_packing.op7_packing,
    "op8_quality": op8_quality.op8_quality,
    "op9_topk": op9_topk.op9_topk,
    "op10_simhash": op10_simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": op6_lines.OP6_SQL, "op9_topk": op9_topk.OP9_SQL}
