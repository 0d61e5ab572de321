"""Queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from logsift.llm.decontamination import op3_decontamination
from logsift.llm.html_text import op8_html_extraction
from logsift.llm.jaccard_join import op9_jaccard_join
from logsift.llm.media import op7_media_columns
from logsift.llm.ngram_lm import op2_lm_scoring
from logsift.llm.packing import op5_packing
from logsift.llm.pii import op4_pii_surrogates
from logsift.llm.token_store import op1_token_store
from logsift.llm.toxicity import op10_toxicity
from logsift.llm.url_filter import op6_url_filters

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_packing": op5_packing,
    "op6_url_filters": op6_url_filters,
    "op7_media_columns": op7_media_columns,
    "op8_html_extraction": op8_html_extraction,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {}
