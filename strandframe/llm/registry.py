"""The queries of this subpackage and the SQL that says the same, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontamination, html_text, licenses, line_dedup, neighbours, quality, sentencepiece_tokens, simhash, token_counts, url_lists, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_simhash": simhash.op2_simhash,
        "op3_sentencepiece": sentencepiece_tokens.op3_sentencepiece,
        "op4_url_lists": url_lists.op4_url_lists,
        "op5_licenses": licenses.op5_licenses,
        "op6_chat": chat.op6_chat,
        "op7_quality": quality.op7_quality,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_html": html_text.op9_html,
        "op10_neighbours": neighbours.op10_neighbours,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_lists": url_lists.OP4_SQL,
        "op5_licenses": licenses.oracle(),
        "op6_chat": chat.OP6_SQL,
        "op8_decontamination": decontamination.OP8_SQL,
        "op11_vector_codes": vector_codes.oracle(),
        "op12_line_dedup": line_dedup.OP12_SQL,
        "op13_centroids": centroids.oracle(),
    }
