"""The registered queries of this subpackage and, where SQL expresses them, their SQL."""

from orbweave.llm import bpe, chat, decontam, fim, jaccard, lattice, mixing, pii, quality, repair, sharding, substrings, toxicity

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_pii": pii.op6_pii,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
    "op10_embedding_near_dedup": lattice.op10_embedding_near_dedup,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_byte_bpe": bpe.op12_byte_bpe,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLES = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op5_ngram_jaccard": jaccard.OP5_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
