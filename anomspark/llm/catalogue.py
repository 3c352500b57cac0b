"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from anomspark.llm import (decontaminate, exact_dedup, html_text, jaccard_join, lemp, mixing, quality_classifier,
                           quality_rules, secrets, sharding, token_file, toxicity, whitening)

QUERIES = {
    "op1_two_pass_shuffle": sharding.op1_two_pass_shuffle,
    "op2_line_blocks": html_text.op2_line_blocks,
    "op3_nb_svm_quality": quality_classifier.op3_nb_svm_quality,
    "op4_budget_mix": mixing.op4_budget_mix,
    "op5_token_file": token_file.op5_token_file,
    "op6_toxicity_mil": toxicity.op6_toxicity_mil,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_lemp_negatives": lemp.op11_lemp_negatives,
    "op12_cholesky_jacobi": whitening.op12_cholesky_jacobi,
    "op13_golomb_dedup": exact_dedup.op13_golomb_dedup,
}

ORACLE = {
    "op8_jaccard_join": jaccard_join.SQL,
    "op11_lemp_negatives": lemp.SQL,
    "op13_golomb_dedup": exact_dedup.SQL,
}
