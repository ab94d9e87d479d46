"""The queries of the text operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import chat, decontaminate, gif, license_scan, line_dedup, mixing, ngram_lm, simhash, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_chat_format": chat.query,
    "op3_gif_media": gif.query,
    "op4_source_mixing": mixing.query,
    "op5_toxicity": toxicity.query,
    "op6_license_scan": license_scan.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_line_dedup": line_dedup.query,
    "op9_ngram_lm": ngram_lm.query,
    "op10_benchmark_decontamination": decontaminate.query,
}

# The others have steps that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = {
    "op2_chat_format": chat.SQL,
    "op4_source_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
}
