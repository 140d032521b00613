"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from reelsift.llm import chat, media, mixing, ngram_join, quality, sentencepieces, token_files, topk, toxicity, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_topk": topk.op3_topk,
    "op4_sentencepiece": sentencepieces.op4_sentencepiece,
    "op5_token_files": token_files.op5_token_files,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat": chat.op7_chat,
    "op8_warc": warc.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
}

ORACLES = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op7_chat": chat.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
