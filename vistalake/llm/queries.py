"""Queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from vistalake.llm.audit import op12_filter_interaction
from vistalake.llm.bpe import op3_bpe_encode_decode
from vistalake.llm.classifier import op11_quality_classifier
from vistalake.llm.decontamination import op2_benchmark_decontamination
from vistalake.llm.jaccard import op7_ngram_jaccard_join
from vistalake.llm.licenses import op6_license_scan
from vistalake.llm.lm import op8_lm_scoring
from vistalake.llm.oracles import ORACLE  # noqa: F401 - read with QUERIES
from vistalake.llm.quality import op4_quality_rules
from vistalake.llm.secrets import op9_secret_scan
from vistalake.llm.search import op13_lexical_search
from vistalake.llm.sharding import op10_sharding
from vistalake.llm.substring import op1_substring_dedup
from vistalake.llm.token_files import op5_token_files

QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_benchmark_decontamination, op3_bpe_encode_decode, op4_quality_rules, op5_token_files,
    op6_license_scan, op7_ngram_jaccard_join, op8_lm_scoring, op9_secret_scan, op10_sharding,
    op11_quality_classifier, op12_filter_interaction, op13_lexical_search)}
