"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import FEW_SQL, ann_of_few, op1_ann
from .bpe import op3_bpe
from .chat_format import OP10_SQL, op10_chat_format
from .codes import OP11_SQL, op11_codes
from .decontam import op2_decontam
from .divergence import OP12_SQL, op12_divergence
from .lang_id import op7_lang_id
from .line_dedup import WHOLE_LINES_SQL, dedup_whole_lines, op4_line_dedup
from .near_dups import op6_near_dups
from .simhash import op13_simhash
from .token_counts import op5_token_counts
from .toxicity import op8_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_decontam": op2_decontam,
    "op3_bpe": op3_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_near_dups": op6_near_dups,
    "op7_lang_id": op7_lang_id,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_chat_format": op10_chat_format,
    "op11_codes": op11_codes,
    "op12_divergence": op12_divergence,
    "op13_simhash": op13_simhash,
    "ann_of_few": ann_of_few,
    "dedup_whole_lines": dedup_whole_lines,
}
ORACLES: dict[str, str] = {"ann_of_few": FEW_SQL, "dedup_whole_lines": WHOLE_LINES_SQL, "op9_warc": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_codes": OP11_SQL, "op12_divergence": OP12_SQL}
