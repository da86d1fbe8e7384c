"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from veilframe.llm import chat_format, collocations, filter_audit, katz, line_dedup, media, ngram_join, packing, quality_fm, quality_rules, secret_scan, sp_viterbi, toxic_crf


def queries() -> dict:
    return {
        "op1_quality_classifier": quality_fm.op1_quality_classifier,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_chat_formatting": chat_format.op4_chat_formatting,
        "op5_media_columns": media.op5_media_columns,
        "op6_sentencepiece": sp_viterbi.op6_sentencepiece,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_lm_scoring": katz.op8_lm_scoring,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_secret_scans": secret_scan.op10_secret_scans,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_toxicity": toxic_crf.op12_toxicity,
        "op13_phrase_collocations": collocations.op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_formatting": chat_format.SQL,
        "op7_quality_rules": quality_rules.SQL,
        "op9_ngram_join": ngram_join.SQL,
        "op10_secret_scans": secret_scan.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op13_phrase_collocations": collocations.SQL,
    }
