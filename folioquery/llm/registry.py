"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from folioquery.llm.fingerprints import OP5_SQL, op5_multiset_hash
from folioquery.llm.line_dedup import op7_line_dedup
from folioquery.llm.mixing import OP6_SQL, op6_mixing
from folioquery.llm.near_dedup import op3_weighted_minhash
from folioquery.llm.packing import op1_harmonic_packing
from folioquery.llm.pii import op8_feistel_pseudonyms
from folioquery.llm.secrets import op4_secret_scan
from folioquery.llm.tiff import op10_tiff
from folioquery.llm.toxicity import op2_nnpu_toxicity
from folioquery.llm.url_filters import OP9_SQL, op9_url_language_model

QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_nnpu_toxicity": op2_nnpu_toxicity,
    "op3_weighted_minhash": op3_weighted_minhash,
    "op4_secret_scan": op4_secret_scan,
    "op5_multiset_hash": op5_multiset_hash,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op9_url_language_model": op9_url_language_model,
    "op10_tiff": op10_tiff,
}

ORACLE_SQL: dict[str, str] = {
    "op5_multiset_hash": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op9_url_language_model": OP9_SQL,
}
