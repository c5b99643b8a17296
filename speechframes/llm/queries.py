"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from speechframes.llm import decontamination, fingerprints, jaccard, language, licenses, mixing, negatives, oracles, periodic, sentencepieces, sharding, suffixes, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_warc": warc.op3_warc,
    "op4_sentencepiece": sentencepieces.op4_sentencepiece,
    "op5_language_id": language.op5_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES = oracles.ORACLES
