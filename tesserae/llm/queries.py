"""The queries that ``__spark_entry__`` registers for this subpackage, and their SQL."""

from __future__ import annotations

from tesserae.llm import divergence, exact, hilbert, jaccard, katz, licenses, media, mixing, neighbours, pieces, repair, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_hilbert_shards": hilbert.op2_hilbert_shards,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_mixing": mixing.op4_mixing,
        "op5_katz": katz.op5_katz,
        "op6_exact_dedup": exact.op6_exact_dedup,
        "op7_suffix_dedup": suffixes.op7_suffix_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_media_columns": media.op9_media_columns,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_near_vectors": neighbours.op11_near_vectors,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_conversation_repair": repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.OP4_SQL, "op6_exact_dedup": exact.OP6_SQL, "op12_source_divergence": divergence.OP12_SQL}
