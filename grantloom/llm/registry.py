"""Queries of the text operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from grantloom.llm.bpe import op1_byte_bpe
from grantloom.llm.chat import op6_chat_repair
from grantloom.llm.codes import op4_token_files
from grantloom.llm.collocations import OP11_SQL, op11_collocations
from grantloom.llm.decontaminate import op10_decontamination
from grantloom.llm.langid import op5_language_id
from grantloom.llm.lines import OP12_SQL, op12_line_dedup
from grantloom.llm.pitman_yor import op3_pitman_yor
from grantloom.llm.quality import op8_quality_rules
from grantloom.llm.ranked import OP13_SQL, op13_ranked_search
from grantloom.llm.secrets import op9_secret_scan
from grantloom.llm.simhash import op2_simhash
from grantloom.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_token_files": op4_token_files,
    "op5_language_id": op5_language_id,
    "op6_chat_repair": op6_chat_repair,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_line_dedup": op12_line_dedup,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op11_collocations": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
