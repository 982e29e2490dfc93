"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, language, licenses, packing, rollup, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_chat": chat.op2_chat,
        "op3_language": language.op3_language,
        "op4_token_counts": rollup.op4_token_counts,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_packing": packing.op6_packing,
        "op7_topk": topk.op7_topk,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_licenses": licenses.op9_licenses,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.OP2_SQL, "op7_topk": topk.OP7_SQL, "op10_url_filter": url_filter.OP10_SQL}
