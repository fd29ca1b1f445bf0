"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, language, line_dedup, near_dedup, order_minhash, quality, sharding, token_files

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_html_text": html_text.op4_html_text,
    "op5_order_minhash": order_minhash.op5_order_minhash,
    "op6_quality": quality.op6_quality,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language": language.op8_language,
    "op9_sharding": sharding.op9_sharding,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

SQL = {
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
