"""The queries of the ten corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from kinfold.llm import (
    op1_fingerprints,
    op2_decontamination,
    op3_language,
    op4_mixing,
    op5_warc,
    op6_quality,
    op7_lm_scoring,
    op8_substrings,
    op9_passages,
    op10_near_duplicates,
)

MODULES = (
    op1_fingerprints,
    op2_decontamination,
    op3_language,
    op4_mixing,
    op5_warc,
    op6_quality,
    op7_lm_scoring,
    op8_substrings,
    op9_passages,
    op10_near_duplicates,
)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
