"""The package's queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from gridweave.llm import chat, digests, jaccard, langid, linkgraph, media, mixing, mixture, negatives, packing, quality, resampling, suffixes

QUERIES = {
    "op1_context_mixing": mixture.op1_context_mixing,
    "op2_fair_mix": mixing.op2_fair_mix,
    "op3_run_index": suffixes.op3_run_index,
    "op4_voronoi_jaccard": jaccard.op4_voronoi_jaccard,
    "op5_quartile_digest": digests.op5_quartile_digest,
    "op6_typed_chat": chat.op6_typed_chat,
    "op7_link_graph": linkgraph.op7_link_graph,
    "op8_cross_parsing": langid.op8_cross_parsing,
    "op9_audio_features": media.op9_audio_features,
    "op10_pattern_packing": packing.op10_pattern_packing,
    "op11_likelihood_ratio": quality.op11_likelihood_ratio,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_radix_negatives": negatives.op13_radix_negatives,
}

ORACLE_SQL = {
    "op2_fair_mix": mixing.OP2_SQL,
    "op6_typed_chat": chat.OP6_SQL,
    "op11_likelihood_ratio": quality.OP11_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
    "op13_radix_negatives": negatives.OP13_SQL,
}
