"""The queries of the training-data operators, and SQL where it can express one."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, html_text, merkle, near_dup, periodic_runs, quality_rules, secret_scan, simhash, substring_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            chat_format.op1_chat_formatting,
            toxicity.op2_toxicity,
            decontaminate.op3_decontamination,
            token_counts.op4_token_counts,
            substring_dedup.op5_substring_dedup,
            html_text.op6_html_extraction,
            near_dup.op7_ngram_jaccard_join,
            byte_bpe.op8_byte_bpe,
            quality_rules.op9_quality_rules,
            secret_scan.op10_secret_scans,
            merkle.op11_merkle_manifest,
            periodic_runs.op12_periodic_runs,
            simhash.op13_simhash_near_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat_format.OP1_SQL, "op11_merkle_manifest": merkle.OP11_SQL}
