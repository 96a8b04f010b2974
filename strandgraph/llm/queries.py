"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from strandgraph.llm.align import op12_tokenizer_alignment
from strandgraph.llm.bpe import op8_byte_bpe
from strandgraph.llm.conversations import op13_conversation_repair
from strandgraph.llm.idfiles import op10_token_ids
from strandgraph.llm.jaccard import op4_ngram_jaccard_join
from strandgraph.llm.leaks import op9_benchmark_decontamination
from strandgraph.llm.licences import op7_license_scans
from strandgraph.llm.lm import op11_lm_scoring
from strandgraph.llm.oracles import ORACLE
from strandgraph.llm.quality import op2_quality_rules
from strandgraph.llm.shards import op3_sharding
from strandgraph.llm.substrings import op5_substring_dedup
from strandgraph.llm.urls import op6_url_filters
from strandgraph.llm.warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_license_scans": op7_license_scans,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_ids": op10_token_ids,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

__all__ = ["ORACLE", "QUERIES"]
