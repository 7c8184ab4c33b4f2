"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerlight.llm.chat import OP9_SQL, op9_chat
from ledgerlight.llm.decontaminate import op10_decontamination
from ledgerlight.llm.language_id import op4_language_id
from ledgerlight.llm.language_model import op8_lm_score
from ledgerlight.llm.mixing import op3_mixing
from ledgerlight.llm.pii import op1_pii
from ledgerlight.llm.quality import op2_quality_rules
from ledgerlight.llm.simhash import op7_simhash
from ledgerlight.llm.suffix_dedup import op5_suffix_dedup
from ledgerlight.llm.tokens import op6_token_counts

QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_lm_score": op8_lm_score,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {"op9_chat": OP9_SQL}
