"""The queries of this subpackage and the SQL that the expressible ones must agree with."""

from __future__ import annotations

from . import bpe, chat, decontam, huffman, pii, quality, simhash, substrings, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_urls": urls.op4_urls,
    "op5_substrings": substrings.op5_substrings,
    "op6_pii": pii.op6_pii,
    "op7_simhash": simhash.op7_simhash,
    "op8_huffman": huffman.op8_huffman,
    "op9_chat": chat.op9_chat,
    "op10_decontamination": decontam.op10_decontamination,
}

ORACLE_SQL = {
    "op3_quality": quality.OP3_SQL,
    "op5_substrings": substrings.OP5_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_decontamination": decontam.OP10_SQL,
}
