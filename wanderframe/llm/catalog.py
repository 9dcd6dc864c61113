"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat_format, decontaminate, ngram_join, quality_classifier, quality_rules, secret_scan, tokens, toxicity, url_filter


def queries():
    return {
        "op1_quality_classifier": quality_classifier.query,
        "op2_token_counts": tokens.count_query,
        "op3_chat_format": chat_format.query,
        "op4_toxicity": toxicity.query,
        "op5_ngram_join": ngram_join.query,
        "op6_quality_rules": quality_rules.query,
        "op7_byte_bpe": tokens.encode_query,
        "op8_decontaminate": decontaminate.query,
        "op9_url_filter": url_filter.query,
        "op10_secret_scan": secret_scan.query,
    }


def oracle_sql():
    return {
        "op3_chat_format": chat_format.ORACLE,
        "op5_ngram_join": ngram_join.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op8_decontaminate": decontaminate.ORACLE,
        "op9_url_filter": url_filter.ORACLE,
    }
