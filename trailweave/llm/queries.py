"""Queries of this subpackage, by name."""

from . import centroids, chat_format, decontamination, html_text, language_id, line_dedup, lm_score, media, mixing, ngram_join, quality, sharding, whitening

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_html_text": html_text.query,
    "op3_lm_score": lm_score.query,
    "op4_quality": quality.query,
    "op5_chat_format": chat_format.query,
    "op6_ngram_join": ngram_join.query,
    "op7_mixing": mixing.query,
    "op8_media": media.query,
    "op9_line_dedup": line_dedup.query,
    "op10_language_id": language_id.query,
    "op11_sharding": sharding.query,
    "op12_centroids": centroids.query,
    "op13_whitening": whitening.query,
}

ORACLE_SQL: dict[str, str] = {"op5_chat_format": chat_format.ORACLE_SQL, "op12_centroids": centroids.ORACLE_SQL}
