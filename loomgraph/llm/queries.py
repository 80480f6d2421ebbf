"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from . import byte_bpe, collocations, decontam, lang_id, line_dedup, mixing, near_dedup, sharding, token_files, topk, toxicity, vector_dedup, word_runs

QUERIES = {
    "op1_impact_topk": topk.op1,
    "op2_source_mixing": mixing.op2,
    "op3_pivot_vector_dedup": vector_dedup.op3,
    "op4_fuzzy_line_dedup": line_dedup.op4,
    "op5_language_id": lang_id.op5,
    "op6_token_files": token_files.op6,
    "op7_minhash_near_dedup": near_dedup.op7,
    "op8_weak_toxicity": toxicity.op8,
    "op9_byte_bpe": byte_bpe.op9,
    "op10_vector_sharding": sharding.op10,
    "op11_decontamination": decontam.op11,
    "op12_collocations": collocations.op12,
    "op13_word_runs": word_runs.op13,
}
SQL = {
    "op1_impact_topk": topk.SQL,
    "op2_source_mixing": mixing.SQL,
    "op3_pivot_vector_dedup": vector_dedup.SQL,
    "op11_decontamination": decontam.SQL,
    "op12_collocations": collocations.SQL,
}
