"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from stratocline.llm import byte_cnn, decontaminate, embedding_join, filter_audit, line_dedup, media, mixing, page_text, setsketch, token_align, token_tree, url_filter, warc_zip

QUERIES = {
    "op1_token_counts": token_tree.op1_token_counts,
    "op2_near_dedup": setsketch.op2_near_dedup,
    "op3_warc": warc_zip.op3_warc,
    "op4_media": media.op4_media,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_page_text": page_text.op8_page_text,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": byte_cnn.op10_quality,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_embedding_dedup": embedding_join.op12_embedding_dedup,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op2_near_dedup": setsketch.OP2_SQL,
    "op3_warc": warc_zip.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_embedding_dedup": embedding_join.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
