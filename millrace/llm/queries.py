"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, licenses, linededup, mil, quality, setjoin, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1,
        "op2_jaccard_join": setjoin.op2,
        "op3_attention_mil": mil.op3,
        "op4_fm_decontamination": decontaminate.op4,
        "op5_byte_bpe": bpe.op5,
        "op6_license_scan": licenses.op6,
        "op7_chat_format": chat.op7,
        "op8_nnpu_toxicity": toxicity.op8,
        "op9_warc_normaliser": warc.op9,
        "op10_line_dedup": linededup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": setjoin.OP2_SQL, "op4_fm_decontamination": decontaminate.OP4_SQL, "op7_chat_format": chat.OP7_SQL, "op9_warc_normaliser": warc.OP9_SQL, "op10_line_dedup": linededup.OP10_SQL}
