"""The queries of this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from stratalog.llm import ann, line_dedup, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, toxicity


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_pii": pii.op3_pii,
        "op4_packing": packing.op4_packing,
        "op5_ann": ann.op5_ann,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_join": ngram_join.ORACLE, "op9_mixing": mixing.ORACLE}
