"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import decontaminate, divergence, langid, licenses, lmscore, mixing, ngramjoin, packing, quality, secrets, tokenstore, toxicity, vectorcodes

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_rules, langid.op2_language_id, ngramjoin.op3_ngram_join, secrets.op4_secret_scan,
        toxicity.op5_toxicity, tokenstore.op6_token_store, decontaminate.op7_decontaminate, lmscore.op8_lm_score,
        mixing.op9_mix_sources, licenses.op10_license_scan, packing.op11_best_fit_packing, vectorcodes.op12_vector_codes,
        divergence.op13_source_divergence,
    )
}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE, "op3_ngram_join": ngramjoin.ORACLE, "op4_secret_scan": secrets.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE, "op9_mix_sources": mixing.ORACLE, "op10_license_scan": licenses.ORACLE,
    "op12_vector_codes": vectorcodes.ORACLE, "op13_source_divergence": divergence.ORACLE,
}
