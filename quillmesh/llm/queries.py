"""Registered queries of this subpackage and the SQL they are checked by."""

from __future__ import annotations

from quillmesh.llm.classifier import op1_query
from quillmesh.llm.chat import OP2_SQL, op2_query
from quillmesh.llm.decontaminate import OP3_SQL, op3_query
from quillmesh.llm.mixture import op6_query
from quillmesh.llm.ngram_join import OP8_SQL, op8_query
from quillmesh.llm.quality_rules import op7_query
from quillmesh.llm.repeats import OP10_SQL, op10_query
from quillmesh.llm.secrets import op9_query
from quillmesh.llm.token_output import op4_query
from quillmesh.llm.url_filter import op5_query

QUERIES = {
    "op1_quality_classifier": op1_query,
    "op2_chat_formatting": op2_query,
    "op3_benchmark_decontamination": op3_query,
    "op4_token_output": op4_query,
    "op5_url_filter": op5_query,
    "op6_source_mixture": op6_query,
    "op7_quality_rules": op7_query,
    "op8_ngram_jaccard_join": op8_query,
    "op9_secret_scan": op9_query,
    "op10_substring_dedup": op10_query,
}

ORACLES = {
    "op2_chat_formatting": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
}
