"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_alignment
from .divergence import OP12_SQL, op12_source_divergence
from .extraction import op13_extraction
from .language_id import op8_language_id
from .line_dedup import OP2_SQL, op2_line_dedup
from .media import op10_media_columns
from .minhash import OP1_SQL, op1_minhash
from .mixing import OP6_SQL, op6_mixing
from .packing import op3_packing
from .quality_crf import op7_quality_classifier
from .quality_rules import OP5_SQL, op5_quality_rules
from .suffix_dedup import op4_suffix_dedup
from .warc import OP9_SQL, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_line_dedup": op2_line_dedup,
        "op3_packing": op3_packing,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_mixing": op6_mixing,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_language_id": op8_language_id,
        "op9_warc": op9_warc,
        "op10_media_columns": op10_media_columns,
        "op11_alignment": op11_alignment,
        "op12_source_divergence": op12_source_divergence,
        "op13_extraction": op13_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op5_quality_rules": OP5_SQL,
        "op6_mixing": OP6_SQL,
        "op9_warc": OP9_SQL,
        "op12_source_divergence": OP12_SQL,
    }
