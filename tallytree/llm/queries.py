"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from . import decontaminate, language, pieces, quality, repetition, rollups, simhash, suffixes, toxicity, training_order

QUERIES = {
    f.__name__: f
    for f in (
        training_order.op1_training_order,
        suffixes.op2_suffix_dedup,
        quality.op3_quality_classifier,
        decontaminate.op4_decontamination,
        toxicity.op5_toxicity,
        language.op6_language_id,
        pieces.op7_sentencepiece,
        simhash.op8_simhash_near_dedup,
        repetition.op9_quality_rules,
        rollups.op10_token_counts,
    )
}
ORACLES = {"op2_suffix_dedup": suffixes.ORACLE_SQL, "op4_decontamination": decontaminate.ORACLE_SQL, "op9_quality_rules": repetition.ORACLE_SQL}
