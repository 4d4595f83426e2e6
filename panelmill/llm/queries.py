"""All registered queries of this subpackage, and the pipeline built from it."""

from __future__ import annotations

import importlib

NAMES = (
    "op1_chat_formatting",
    "op2_topk_search",
    "op3_byte_bpe",
    "op4_lm_scoring",
    "op5_decontamination",
    "op6_pii",
    "op7_suffix_dedup",
    "op8_license_scan",
    "op9_toxicity",
    "op10_simhash",
    "op11_mixing",
    "op12_periodic_runs",
    "op13_whitening",
)


def load():
    """(queries, SQL twins): each module op* has `query(spark, sf_dir)` and `ORACLE_SQL` (None where SQL cannot say it)."""
    import corpus_pipeline

    found, twins = {"pipeline": corpus_pipeline.run}, {}
    if corpus_pipeline.ORACLE_SQL:
        twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    for name in NAMES:
        module = importlib.import_module(f"panelmill.llm.{name}")
        found[name] = module.query
        if module.ORACLE_SQL:
            twins[name] = module.ORACLE_SQL
    return found, twins
