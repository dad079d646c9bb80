"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import ann, chat, decontaminate, jaccard, packing, pii, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_ann": ann.op2_ann,
    "op3_warc": warc.op3_warc,
    "op4_packing": packing.op4_packing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_chat": chat.op9_chat,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_suffix_dedup": suffix_dedup.OP10_SQL,
}
