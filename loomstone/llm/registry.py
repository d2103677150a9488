"""The queries of this subpackage and their SQL."""

from loomstone.llm import chat, decontaminate, jaccard, licences, media, mixing, oracles, quality, sharding, suffixes, token_ids

QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_quality": quality.op2_quality,
    "op3_media": media.op3_media,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_chat": chat.op5_chat,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_ids": token_ids.op9_token_ids,
    "op10_suffixes": suffixes.op10_suffixes,
}
ORACLES = {"op4_jaccard": oracles.JACCARD, "op5_chat": oracles.CHAT, "op10_suffixes": oracles.SUFFIXES}
