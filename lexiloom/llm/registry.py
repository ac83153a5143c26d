"""Queries of the training-data operators and their SQL. All modules are imported here, so that whoever imports this knows whether they can be."""

from __future__ import annotations

from lexiloom.llm import fingerprints, linededup, lm, media, merkle, mixing, neardedup, packing, pii, quality, search, secrets, tokencounts

QUERIES = {
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_quality": quality.op3_quality,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_secrets": secrets.op5_secrets,
    "op1_mixing": mixing.op1_mixing,
    "op6_media": media.op6_media,
    "op7_token_counts": tokencounts.op7_token_counts,
    "op8_near_dedup": neardedup.op8_near_dedup,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_packing": packing.op10_packing,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_merkle": merkle.op12_merkle,
    "op13_pii": pii.op13_pii,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return mixing.SQL | secrets.SQL | linededup.SQL | search.SQL | merkle.SQL
