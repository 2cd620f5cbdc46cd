"""The subpackage's queries and their SQL."""

from __future__ import annotations

from plateflow.llm.bpe import op8_byte_bpe
from plateflow.llm.conversations import OP12_SQL, op12_conversation_repair
from plateflow.llm.decontaminate import OP3_SQL, op3_decontamination
from plateflow.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from plateflow.llm.hpylm import op4_lm_scoring
from plateflow.llm.langid import op2_language_id
from plateflow.llm.licenses import op9_license_scan
from plateflow.llm.line_dedup import OP7_SQL, op7_line_dedup
from plateflow.llm.quality import OP10_SQL, op10_quality_rules
from plateflow.llm.quality_model import op13_quality_classifier
from plateflow.llm.simhash import op5_simhash_near_dedup
from plateflow.llm.suffix_dedup import op1_suffix_array_dedup
from plateflow.llm.token_files import op6_token_files

QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_language_id, op3_decontamination, op4_lm_scoring, op5_simhash_near_dedup, op6_token_files, op7_line_dedup, op8_byte_bpe, op9_license_scan, op10_quality_rules, op11_hard_negatives, op12_conversation_repair, op13_quality_classifier)}
SQL = {"op3_decontamination": OP3_SQL, "op7_line_dedup": OP7_SQL, "op10_quality_rules": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_conversation_repair": OP12_SQL}
