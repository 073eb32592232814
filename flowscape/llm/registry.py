"""Queries and SQL oracles of the corpus operators, as __spark_entry__ adds them."""

from __future__ import annotations

from . import chat, decontaminate, licenses, media, mixing, neardup, pipeline, quality, secrets, substrings, webtext


def queries() -> dict:
    return {
        "op1_leaks": decontaminate.op1_leaks,
        "op2_chat": chat.op2_chat,
        "op3_quality": quality.op3_quality,
        "op4_mixing": mixing.op4_mixing,
        "op5_substrings": substrings.op5_substrings,
        "op6_media": media.op6_media,
        "op7_licenses": licenses.op7_licenses,
        "op8_neardup": neardup.op8_neardup,
        "op9_webtext": webtext.op9_webtext,
        "op10_secrets": secrets.op10_secrets,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": chat.ORACLE,
    }
