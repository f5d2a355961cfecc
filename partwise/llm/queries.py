"""The queries of this subpackage, one per operator, and their DuckDB equivalents."""

from __future__ import annotations

from partwise.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, license_scan, line_dedup, near_dedup, pack, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_near_dedup": near_dedup.query,
    "op3_decontaminate": decontaminate.query,
    "op4_license_scan": license_scan.query,
    "op5_language_id": language_id.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_chat_format": chat_format.query,
    "op8_html_extract": html_extract.query,
    "op9_pack": pack.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
}
