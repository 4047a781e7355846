"""The operators' queries over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from .chat import OP2_SQL, op2_format_chats
from .codes import OP11_SQL, op11_vector_codes
from .licenses import op5_license_scan
from .media import op10_media_columns
from .mixture import OP9_SQL, op9_mix_sources
from .pieces import op3_sentencepiece
from .quality import op8_quality_rules
from .shards import OP7_SQL, op7_shards
from .simhash import op1_simhash_near_dedup
from .spots import op12_spot_signatures
from .suffix_array import OP6_SQL, op6_suffix_array_dedup
from .suffix_trees import OP4_SQL, op4_substring_dedup
from .whitening import op13_whiten_embeddings

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_format_chats": op2_format_chats,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_shards": op7_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_mix_sources": op9_mix_sources,
    "op10_media_columns": op10_media_columns,
    "op11_vector_codes": op11_vector_codes,
    "op12_spot_signatures": op12_spot_signatures,
    "op13_whiten_embeddings": op13_whiten_embeddings,
}

ORACLE_SQL = {
    "op2_format_chats": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_suffix_array_dedup": OP6_SQL,
    "op7_shards": OP7_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
}
