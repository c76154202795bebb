"""The queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hnsw, licenses, packing, pii, quality, simhash, snapshots, toxicity, variants, vectorcodes, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_byte_bpe": bpe.op2,
        "op3_quality_rules": quality.op3,
        "op4_simhash": simhash.op4,
        "op5_warc": warc.op5,
        "op6_packing": packing.op6,
        "op7_hnsw": hnsw.op7,
        "op8_licenses": licenses.op8,
        "op9_pii": pii.op9,
        "op10_chat": chat.op10,
        "op11_spelling": variants.op11,
        "op12_vector_codes": vectorcodes.op12,
        "op13_exact_dedup": snapshots.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.OP3_SQL, "op5_warc": warc.OP5_SQL, "op9_pii": pii.OP9_SQL, "op10_chat": chat.OP10_SQL, "op11_spelling": variants.OP11_SQL, "op12_vector_codes": vectorcodes.OP12_SQL, "op13_exact_dedup": snapshots.OP13_SQL}
