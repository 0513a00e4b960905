"""Registered queries of the subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from ferret.llm.bpe import op3_bpe
from ferret.llm.chat import op9_chat
from ferret.llm.decontam import OP1_SQL, op1_decontam
from ferret.llm.jaccard import OP5_SQL, op5_jaccard
from ferret.llm.langid import op4_langid
from ferret.llm.lm import op8_lm
from ferret.llm.periods import op11_periods
from ferret.llm.quality import op7_quality
from ferret.llm.repeats import op10_repeats
from ferret.llm.secrets import op2_secrets
from ferret.llm.turns import OP13_SQL, op13_turns
from ferret.llm.vectors import op6_vectors
from ferret.llm.windows import OP12_SQL, op12_windows

QUERIES = {
    "op1_decontam": op1_decontam,
    "op2_secrets": op2_secrets,
    "op3_bpe": op3_bpe,
    "op4_langid": op4_langid,
    "op5_jaccard": op5_jaccard,
    "op6_vectors": op6_vectors,
    "op7_quality": op7_quality,
    "op8_lm": op8_lm,
    "op9_chat": op9_chat,
    "op10_repeats": op10_repeats,
    "op11_periods": op11_periods,
    "op12_windows": op12_windows,
    "op13_turns": op13_turns,
}
ORACLE: dict[str, str] = {
    "op1_decontam": OP1_SQL,
    "op5_jaccard": OP5_SQL,
    "op12_windows": OP12_SQL,
    "op13_turns": OP13_SQL,
}
