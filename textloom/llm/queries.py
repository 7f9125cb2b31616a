"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from textloom.llm import embeddings, jaccard, lines, lm, media, mixing, pieces, quality, repeats, urlfilter

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_media_columns": media.op6_media_columns,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
    "op10_url_filters": urlfilter.op10_url_filters,
}
SQL: dict[str, str] = {
    "op2_line_dedup": lines.SQL,
    "op3_source_mixing": mixing.SQL,
    "op5_embedding_dedup": embeddings.SQL,
    "op10_url_filters": urlfilter.SQL,
}
