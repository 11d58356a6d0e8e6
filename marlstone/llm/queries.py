"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .chat import OP5_SQL, op5_chat_formatting
from .collocations import OP11_SQL, op11_collocations
from .curve import op12_packing
from .decontamination import op4_decontamination
from .language import op2_language_id
from .packing import op6_best_fit_packing
from .quality import op8_quality_classifier
from .rules import OP1_SQL, op1_quality_rules
from .simhash import op9_simhash
from .substrings import OP7_SQL, op7_substring_dedup
from .tokens import op3_token_counts
from .toxicity import op10_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
