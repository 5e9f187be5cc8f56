"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from corpuslake.llm import alignment, decontaminate, langmodel, language, mixing, nearest, personal, quality, resampling, simhash, substrings, suffixes, toxicity


def queries() -> dict:
    found = (
        language.op1_language_id,
        langmodel.op2_lm_scoring,
        substrings.op3_substring_dedup,
        decontaminate.op4_decontamination,
        decontaminate.proximity_decontamination,
        quality.op5_quality_fm,
        mixing.op6_source_mixing,
        suffixes.op7_suffix_dedup,
        nearest.op8_block_matrix_knn,
        simhash.op9_simhash_dedup,
        toxicity.op10_toxicity,
        resampling.op11_importance_resampling,
        alignment.op12_tokenizer_alignment,
        personal.op13_personal_data,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    found = {
        "op3_substring_dedup": substrings.ORACLE,
        "op4_decontamination": decontaminate.ORACLE,
        "proximity_decontamination": decontaminate.PROXIMITY_ORACLE,
        "op6_source_mixing": mixing.ORACLE,
        "op7_suffix_dedup": suffixes.ORACLE,
        "op8_block_matrix_knn": nearest.ORACLE,
        "op11_importance_resampling": resampling.ORACLE,
    }
    return found
