"""Queries of the training-data operators, by name, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from rankweave.llm import chat, decontamination, fingerprint, html_text, language_id, license_scan, line_dedup, mixing, near_dedup, prefix_trie, structure_repair, token_output, warc
from rankweave.llm.common import Query

QUERIES: dict[str, Query] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_warc": warc.op3_warc,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_token_output": token_output.op7_token_output,
    "op8_mixing": mixing.op8_mixing,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_structure_repair": structure_repair.op11_structure_repair,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_html_text": html_text.op13_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.OP3_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op11_structure_repair": structure_repair.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
