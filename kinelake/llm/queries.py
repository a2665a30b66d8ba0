"""Queries of the corpus operators and the SQL that SQL can express."""

from __future__ import annotations

from kinelake.llm import exact_dedup, html_extract, jaccard_join, language_id, media, mixing, sentencepiece_codec, sharding, simhash, source_divergence, substring_dedup, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_shard": sharding.op1_shard,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_mix": mixing.op3_mix,
        "op4_language_id": language_id.op4_language_id,
        "op5_media": media.op5_media,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_html_extract": html_extract.op10_html_extract,
        "op11_simhash": simhash.op11_simhash,
        "op12_source_divergence": source_divergence.op12_source_divergence,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": mixing.OP3_SQL, "op6_jaccard_join": jaccard_join.OP6_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op12_source_divergence": source_divergence.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
