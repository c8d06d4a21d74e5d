"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from siftlake.llm import alignment, attribution, collisions, fingerprint, line_dedup, media, mixing, packing, pii, quality, repeats, runs, simhash

QUERIES = {
    query.__name__: query
    for query in (
        fingerprint.op1_weighted_fingerprints,
        quality.op2_quality_scores,
        mixing.op3_mixed_sources,
        pii.op4_personal_data,
        media.op5_media_columns,
        simhash.op6_simhash_components,
        line_dedup.op7_line_dedup,
        attribution.op8_token_counts,
        packing.op9_pack_sequences,
        repeats.op10_repeated_strings,
        runs.op11_periodic_runs,
        collisions.op12_near_components,
        alignment.op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {"op7_line_dedup": line_dedup.OP7_SQL}
