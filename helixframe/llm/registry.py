"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op02_decontamination, op06_licence_scan, op08_line_dedup
from .op01_substring_dedup import op1_substring_dedup
from .op02_decontamination import op2_decontamination
from .op03_near_dedup import op3_near_dedup
from .op04_toxicity import op4_toxicity
from .op05_token_counts import op5_token_counts
from .op06_licence_scan import op6_licence_scan
from .op07_embedding_dedup import op7_embedding_dedup
from .op08_line_dedup import op8_line_dedup
from .op09_html_extraction import op9_html_extraction
from .op10_mixing import op10_mixing

_ALL = (
    op1_substring_dedup,
    op2_decontamination,
    op3_near_dedup,
    op4_toxicity,
    op5_token_counts,
    op6_licence_scan,
    op7_embedding_dedup,
    op8_line_dedup,
    op9_html_extraction,
    op10_mixing,
)
_SQL = {
    "op2_decontamination": op02_decontamination.ORACLE_SQL,
    "op6_licence_scan": op06_licence_scan.ORACLE_SQL,
    "op8_line_dedup": op08_line_dedup.ORACLE_SQL,
}


def queries() -> dict:
    return {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
