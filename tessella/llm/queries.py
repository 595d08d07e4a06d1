"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import bpe, chat, exact_dedup, licenses, packing, pii, quality, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_licenses": licenses.op4_licenses,
    "op5_bpe": bpe.op5_bpe,
    "op6_chat": chat.op6_chat,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
}
SQL = {
    "op1_quality": quality.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_licenses": licenses.SQL,
    "op6_chat": chat.SQL,
}
