"""The queries of this subpackage, one for each operator, and their SQL twins."""

from __future__ import annotations

import importlib

#: Query name -> module that holds query() and, where SQL can express it, SQL.
MODULES = {
    "op4_host_suffix_text": "html_text",
    "op6_bootstrapped_pii": "pii",
    "op8_suffix_levels": "suffix_index",
    "op7_jaccard_join": "jaccard_join",
    "op10_differencing": "packing",
    "op3_decontaminate": "decontaminate",
    "op2_warc": "warc",
    "op1_prefix_targets": "chat",
    "op5_tokenizer_fertility": "fertility",
    "op9_hypergeometric_shards": "sharding",
    "op13_fm_phrases": "phrases",
    "op12_super_kmers": "superkmer",
    "op11_merkle_manifest": "merkle",
}

QUERIES: dict = {}
ORACLE: dict = {}
for _name, _module in MODULES.items():
    _found = importlib.import_module(f"strandloom.llm.{_module}")
    QUERIES[_name] = _found.query
    if _found.SQL:
        ORACLE[_name] = _found.SQL
