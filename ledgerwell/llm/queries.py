"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from ledgerwell.llm.decontam import OP1_SQL, op1_decontamination
from ledgerwell.llm.dialogue import OP11_SQL, op11_conversation_repair
from ledgerwell.llm.langid import op8_language
from ledgerwell.llm.mixing import op10_mix_sources
from ledgerwell.llm.neardup import OP9_SQL, op9_minhash_groups
from ledgerwell.llm.pii import OP13_SQL, op13_private_data
from ledgerwell.llm.quality import OP5_SQL, op5_quality_rules
from ledgerwell.llm.rendering import op7_html_text
from ledgerwell.llm.secrets import op3_secret_scan
from ledgerwell.llm.substrings import OP6_SQL, op6_substring_dedup
from ledgerwell.llm.toxicity import op4_toxicity
from ledgerwell.llm.variants import OP12_SQL, op12_spelling_variants
from ledgerwell.llm.warc import OP2_SQL, op2_warc_archive

QUERIES = {"op1_decontamination": op1_decontamination, "op2_warc_archive": op2_warc_archive, "op3_secret_scan": op3_secret_scan, "op4_toxicity": op4_toxicity, "op5_quality_rules": op5_quality_rules, "op6_substring_dedup": op6_substring_dedup, "op7_html_text": op7_html_text, "op8_language": op8_language, "op9_minhash_groups": op9_minhash_groups, "op10_mix_sources": op10_mix_sources, "op11_conversation_repair": op11_conversation_repair, "op12_spelling_variants": op12_spelling_variants, "op13_private_data": op13_private_data}

ORACLE = {"op2_warc_archive": OP2_SQL, "op1_decontamination": OP1_SQL, "op5_quality_rules": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op9_minhash_groups": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_private_data": OP13_SQL}
