"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, langid, pieces, quality, sharding, simhash, suffixes, tokens, urls

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_token_ids": tokens.op2_token_ids,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_url_filter": urls.op4_url_filter,
    "op5_simhash": simhash.op5_simhash,
    "op6_pieces": pieces.op6_pieces,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "quality_base": quality.quality_base,
    "op9_language_id": langid.op9_language_id,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}

ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op4_url_filter": urls.OP4_SQL,
    "quality_base": quality.BASE_SQL,
}
