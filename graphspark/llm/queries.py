"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .common import Query
from .decontamination import OP2_SQL, op2_decontamination
from .language import op4_language
from .lm_scores import OP7_SQL, op7_lm_scores
from .near_duplicates import OP6_SQL, op6_near_duplicates
from .packing import op10_packing
from .pii import op1_personal_data
from .quality import OP3_SQL, op3_quality_rules
from .substring_duplicates import OP8_SQL, op8_substring_duplicates
from .token_counts import op9_token_counts


def queries() -> dict[str, Query]:
    made = [op1_personal_data, op2_decontamination, op3_quality_rules, op4_language, op5_chat_formatting, op6_near_duplicates, op7_lm_scores, op8_substring_duplicates, op9_token_counts, op10_packing]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": OP2_SQL,
        "op3_quality_rules": OP3_SQL,
        "op5_chat_formatting": OP5_SQL,
        "op6_near_duplicates": OP6_SQL,
        "op7_lm_scores": OP7_SQL,
        "op8_substring_duplicates": OP8_SQL,
    }
