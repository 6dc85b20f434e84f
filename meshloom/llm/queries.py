"""The queries of this subpackage and the SQL that gives their rows."""

from __future__ import annotations

from meshloom.llm import decontaminate, html_extract, license_scan, lm_scoring, merkle, mixing, ngram_join, quality_rules, resample, secret_scan, set_sketch, url_filter, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_warc": warc.op5_warc,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_importance_resample": resample.op11_importance_resample,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_set_sketch": set_sketch.op13_set_sketch,
    "quality_ablation": quality_rules.quality_ablation,
}
ORACLES = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_ngram_join": ngram_join.SQL,
    "op5_warc": warc.SQL,
    "op6_url_filter": url_filter.SQL,
    "op8_mix_sources": mixing.SQL,
    "op11_importance_resample": resample.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_set_sketch": set_sketch.SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
}
