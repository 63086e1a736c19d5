"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from lumengraph.llm import fingerprints, jaccard_join, licenses, media_columns, mixing, sentencepieces, suffix_dedup, toxicity
from lumengraph.llm.token_count import op5_token_counts
from lumengraph.llm.token_shards import op1_token_shards

QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_sentencepieces": sentencepieces.op2_sentencepieces,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_media_columns": media_columns.op9_media_columns,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}
ORACLES: dict[str, str] = {
    "op3_license_scan": licenses.oracle(),
    "op6_mixing": mixing.ORACLE,
}
