"""Registered queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

from cairn.llm import bpe, media, minhash, mixing, neighbours, pages, quality, substrings, toolcalls, urls
from cairn.llm.shared import shipped

QUERIES = {
    "op1_tool_calls": toolcalls.op1,
    "op2_quality_classifier": quality.op2,
    "op3_substring_dedup": substrings.op3,
    "op4_host_boilerplate": pages.op4,
    "op5_temporal_url_lists": urls.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_mix_sources": mixing.op7,
    "op8_media_columns": media.op8,
    "op9_nearest_neighbours": neighbours.op9,
    "op10_minhash_near_dedup": minhash.op10,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
SQL = {
    "op3_substring_dedup": substrings.OP3_SQL,
    "op5_temporal_url_lists": urls.OP5_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
}
