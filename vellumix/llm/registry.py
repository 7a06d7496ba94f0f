"""Queries of the training-data operators, one for each, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumix.llm import licenses, line_quality, warc
from vellumix.llm.bloom_lm import op10_bloom_lm
from vellumix.llm.licenses import op8_licenses
from vellumix.llm.line_chunks import op3_line_chunks
from vellumix.llm.line_quality import op4_line_quality
from vellumix.llm.merge_dropout import op7_merge_dropout
from vellumix.llm.neighbour_quality import op9_neighbour_quality
from vellumix.llm.ogg import op1_ogg
from vellumix.llm.order_minhash import op2_order_minhash
from vellumix.llm.packing import op6_packing
from vellumix.llm.warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ogg": op1_ogg, "op2_order_minhash": op2_order_minhash, "op3_line_chunks": op3_line_chunks, "op4_line_quality": op4_line_quality, "op5_warc": op5_warc, "op6_packing": op6_packing, "op7_merge_dropout": op7_merge_dropout, "op8_licenses": op8_licenses, "op9_neighbour_quality": op9_neighbour_quality, "op10_bloom_lm": op10_bloom_lm}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_quality": line_quality.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op8_licenses": licenses.ORACLE_SQL}
