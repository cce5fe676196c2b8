"""Queries and SQL of the training-data operators, for the entry point."""

from __future__ import annotations

from . import ann_search, ball_kmeans, conversation_repair, embedding_dedup, jaccard_join, license_scan, line_dedup, mixing, packing, sentencepiece_codec, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_ann_search": ann_search.op9_ann_search,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_mixing": mixing.op11_mixing,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_ball_kmeans": ball_kmeans.op13_ball_kmeans,
}

ORACLES = {"op8_url_filter": url_filter.SQL, "op11_mixing": mixing.SQL, "op13_ball_kmeans": ball_kmeans.SQL}
