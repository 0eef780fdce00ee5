"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestar.llm import decontaminate, extract, huffman, langid, packing, pii, quality, simhash, suffix_dedup, warc

_FUNCTIONS = [
    extract.op1_extract, pii.op2_pii, warc.op3_warc, quality.op4_quality, suffix_dedup.op5_suffix_dedup,
    packing.op6_packing, langid.op7_langid, simhash.op8_simhash, decontaminate.op9_decontaminate, huffman.op10_huffman,
]
#: The others rest on trained trees, trees of pages, keyed permutations, XXH64 or a tokenizer, which SQL cannot express; tests hold them against plain code.
_SQL = {"op3_warc": warc.ORACLE_SQL, "op5_suffix_dedup": suffix_dedup.ORACLE_SQL, "op7_langid": langid.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL}


def queries():
    """Name -> callable(spark, sf_dir)."""
    return {f.__name__: f for f in _FUNCTIONS}


def oracle_sql():
    """Name -> DuckDB SQL."""
    return dict(_SQL)
