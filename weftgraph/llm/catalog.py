"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from weftgraph.llm import chat, convrepair, decontaminate, exactdedup, filteraudit, langmodel, licenses, linededup, neardup, sentencepieces, tiff, toxicity, urlfilter


def queries() -> dict[str, Callable]:
    return {
        "op1_minhash": neardup.op1_minhash,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_langmodel": langmodel.op3_langmodel,
        "op4_chat_format": chat.op4_chat_format,
        "op5_tiff": tiff.op5_tiff,
        "op6_licenses": licenses.op6_licenses,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_urlfilter": urlfilter.op8_urlfilter,
        "op9_sentencepiece": sentencepieces.op9_sentencepiece,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_conversation_repair": convrepair.op11_conversation_repair,
        "op12_filter_audit": filteraudit.op12_filter_audit,
        "op13_exact_dedup": exactdedup.op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": neardup.ORACLE,
        "op2_line_dedup": linededup.ORACLE,
        "op4_chat_format": chat.ORACLE,
        "op8_urlfilter": urlfilter.ORACLE,
        "op11_conversation_repair": convrepair.ORACLE,
        "op12_filter_audit": filteraudit.ORACLE,
        "op13_exact_dedup": exactdedup.ORACLE,
    }
