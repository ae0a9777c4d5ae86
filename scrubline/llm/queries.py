"""The registered queries of this subpackage and their SQL."""

from . import bpe, chat_format, cross_tokens, exact_dedup, language_id, license_scan, media_ts, near_dedup, ngram_join, packing, quality, suffix_dedup, vector_codes

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_language_id": language_id.op3_language_id,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_media_ts": media_ts.op9_media_ts,
    "op10_quality": quality.op10_quality,
    "op11_cross_tokens": cross_tokens.op11_cross_tokens,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op2_license_scan": license_scan.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
