"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage whose ``query(spark, sf_dir)`` it is; a module may have ``ORACLE_SQL``.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_packing": "packing",
    "op3_suffix_dedup": "suffix_dedup",
    "op4_mixing": "mixing",
    "op5_simhash": "simhash",
    "op6_pseudo_likelihood": "pseudo_likelihood",
    "op7_token_store": "token_store",
    "op8_topk": "topk",
    "op9_media": "media",
    "op10_quality": "quality",
    "op11_collocations": "collocations",
    "op12_fingerprints": "fingerprints",
    "op13_spelling": "spelling",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__name__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
