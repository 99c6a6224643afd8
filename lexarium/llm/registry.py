"""The queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from . import jaccard, line_dedup, neighbours, packing, pieces, quality_model, quality_rules, suffix, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_warc": warc.op2_warc,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_quality_classifier": quality_model.op5_quality_classifier,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_suffix_array_dedup": suffix.op8_suffix_array_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op3_nearest_neighbours": neighbours.OP3_SQL,
    "op4_ngram_jaccard_join": jaccard.OP4_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op8_suffix_array_dedup": suffix.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
