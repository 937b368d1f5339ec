"""Registered queries of the training-data operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from companylens.llm.ballcodes import op12_ball_codes
from companylens.llm.decontaminate import op6_template_decontamination
from companylens.llm.divergence import op13_source_divergence
from companylens.llm.gam import op8_additive_quality
from companylens.llm.html_text import op3_template_extraction
from companylens.llm.langmodel import op4_bloom_lm_scores
from companylens.llm.minhash import op9_minhash_near_dedup
from companylens.llm.oracles import ORACLES  # noqa: F401
from companylens.llm.packing import op10_best_fit_packing
from companylens.llm.quality_rules import op7_divergence_quality
from companylens.llm.records import op5_token_records
from companylens.llm.repeats import op1_suffix_array_dedup
from companylens.llm.substrings import op11_prefix_suffix_trees
from companylens.llm.toxicity import op2_factorization_toxicity

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_factorization_toxicity": op2_factorization_toxicity,
    "op3_template_extraction": op3_template_extraction,
    "op4_bloom_lm_scores": op4_bloom_lm_scores,
    "op5_token_records": op5_token_records,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_divergence_quality": op7_divergence_quality,
    "op8_additive_quality": op8_additive_quality,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_suffix_trees": op11_prefix_suffix_trees,
    "op12_ball_codes": op12_ball_codes,
    "op13_source_divergence": op13_source_divergence,
}
