"""Queries and SQL of this subpackage, by name."""

from . import decontaminate, html_text, licences, line_dedup, lm_score, mixing, near_dedup, quality, suffix_dedup, toxicity
from .common import shipped

QUERIES = {
    name: shipped(query)
    for name, query in {
        "op1_lm_score": lm_score.op1_lm_score,
        "op2_html_text": html_text.op2_html_text,
        "op3_licences": licences.op3_licences,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
    }.items()
}

ORACLE_SQL = {"op1_lm_score": lm_score.OP1_SQL, "op3_licences": licences.OP3_SQL, "op8_quality_rules": quality.OP8_SQL}
