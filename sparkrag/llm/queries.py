"""Queries and SQL of the training-data operators and the pipeline."""

from __future__ import annotations

from . import op1_mix, op2_quality, op3_tokens, op4_extract, op5_warc, op6_shards, op7_simhash, op8_rules, op9_licenses, op10_decontaminate

MODULES = (op1_mix, op2_quality, op3_tokens, op4_extract, op5_warc, op6_shards, op7_simhash, op8_rules, op9_licenses, op10_decontaminate)


def queries() -> dict:
    return {m.__name__.rsplit(".", 1)[1]: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.__name__.rsplit(".", 1)[1]: m.SQL for m in MODULES if hasattr(m, "SQL")}
