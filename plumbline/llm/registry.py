"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from plumbline.llm import (
    bpe_codec,
    chat_format,
    lexical_search,
    line_dedup,
    ogg_media,
    quality_classifier,
    quality_rules,
    simhash,
    source_mixing,
    spelling,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_source_mixing": source_mixing.op3_source_mixing,
    "op4_ogg_media": ogg_media.op4_ogg_media,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_byte_bpe": bpe_codec.op7_byte_bpe,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
#: The others have no plain SQL twin (hash functions, tokenizers, media, training); tests hold them against brute force.
ORACLES = {"op1_line_dedup": line_dedup.OP1_SQL, "op8_chat_format": chat_format.OP8_SQL, "op9_quality_rules": quality_rules.OP9_SQL, "op11_lexical_search": lexical_search.OP11_SQL}
