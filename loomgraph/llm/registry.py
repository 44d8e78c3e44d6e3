"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import ann, byte_bpe, chat_format, decontaminate, filter_audit, html_text, language_id, line_dedup, minhash, secret_scan, token_align, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_ann_search": ann.op8_ann_search,
    "op9_html_text": html_text.op9_html_text,
    "op10_minhash_dedup": minhash.op10_minhash_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_token_align": token_align.op13_token_align,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_secret_scan": secret_scan.ORACLE,
}
