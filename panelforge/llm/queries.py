"""The operators' named queries, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.bpe import op3_bpe
from panelforge.llm.chat import op11_chat
from panelforge.llm.jaccard import op10_jaccard
from panelforge.llm.katz import op4_katz
from panelforge.llm.langid import op2_langid
from panelforge.llm.media import op7_media
from panelforge.llm.packing import op6_packing
from panelforge.llm.pii import op1_pii
from panelforge.llm.quality import op9_quality
from panelforge.llm.repair import op13_repair
from panelforge.llm.spelling import op12_spelling
from panelforge.llm.suffix_dedup import op8_suffix_dedup
from panelforge.llm.token_files import op5_token_files



def op4_katz_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_katz(spark, sf_dir, order=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_langid": op2_langid,
    "op3_bpe": op3_bpe,
    "op4_katz": op4_katz_3,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_media": op7_media,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_jaccard": op10_jaccard,
    "op11_chat": op11_chat,
    "op12_spelling": op12_spelling,
    "op13_repair": op13_repair,
}
SQL: dict[str, str] = {}
