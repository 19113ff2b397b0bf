"""Queries of the training-data operators and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import ann, chat, decontam, langid, license, lm, mixing, neardup, pii, warc

QUERIES = {
    "op1_warc_derivatives": warc.op1_warc_derivatives,
    "op2_license_scan": license.op2_license_scan,
    "op3_pii_scan": pii.op3_pii_scan,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_language_id": langid.op6_language_id,
    "op7_chat_format": chat.op7_chat_format,
    "op8_lm_score": lm.op8_lm_score,
    "op9_additive_quantisation": ann.op9_additive_quantisation,
    "op10_near_duplicates": neardup.op10_near_duplicates,
}

ORACLE_SQL = {
    "op1_warc_derivatives": warc.OP1_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op7_chat_format": chat.OP7_SQL,
}
