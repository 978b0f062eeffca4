"""The registered queries of this subpackage and their SQL (where SQL can express the result)."""

from kinweave.llm import chat, decontam, langid, packing, pii, rules, secrets, simhash, substrings, warc

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_pii": pii.op2_pii,
    "op3_rules": rules.op3_rules,
    "op4_secrets": secrets.op4_secrets,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_warc": warc.op7_warc,
    "op8_substrings": substrings.op8_substrings,
    "op9_decontam": decontam.op9_decontam,
    "op10_langid": langid.op10_langid,
}

ORACLES = {
    "op1_chat": chat.OP1_SQL,
    "op3_rules": rules.OP3_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_substrings": substrings.OP8_SQL,
    "op9_decontam": decontam.OP9_SQL,
}
