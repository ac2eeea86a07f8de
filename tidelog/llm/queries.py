"""The corpus operators' queries and their DuckDB SQL, by registered name."""

from __future__ import annotations

from . import decontamination, embeddings, html, language_id, mixing, sharding, simhash, substrings, tokens, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_substrings": substrings.op2_substrings,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_html": html.op5_html,
    "op6_language": language_id.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_tokens": tokens.op10_tokens,
}

ORACLE_SQL = {
    "op2_substrings": substrings.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op9_embeddings": embeddings.OP9_SQL,
}
