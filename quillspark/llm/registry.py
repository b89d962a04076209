"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quillspark.llm import centroids, decontaminate, line_dedup, mixing, near_dedup, pieces, pii, quality_classifier, quality_rules, substring_dedup, token_output, warc
from quillspark.llm.runtime import read_table


def _documents(operator):
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_containment_decontamination": decontaminate.query,
        "op2_fuzzy_line_dedup": _documents(line_dedup.line_dedup),
        "op3_quality_rules": _documents(quality_rules.quality_rules),
        "op4_bootstrapped_pii": _documents(pii.personal_data),
        "op5_context_mixing_tokens": _documents(token_output.token_output),
        "op6_warc_transactions": warc.query,
        "op7_rule_ensemble_quality": quality_classifier.query,
        "op8_hyperminhash_dedup": _documents(near_dedup.near_duplicates),
        "op10_temperature_mixing": _documents(mixing.mix),
        "op11_interval_centroids": centroids.query,
        "op12_offset_pieces": _documents(pieces.round_trip),
        "op9_debruijn_substring_dedup": _documents(substring_dedup.remove_repeats),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_containment_decontamination": decontaminate.oracle(),
        "op3_quality_rules": quality_rules.oracle(),
        "op10_temperature_mixing": mixing.ORACLE,
        "op11_interval_centroids": centroids.oracle(),
        "op6_warc_transactions": warc.ORACLE,
        "op9_debruijn_substring_dedup": substring_dedup.ORACLE,
    }
