"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from veriscribe.llm import best_fit_packing, decontaminate, html_extraction, language_model, pii, quality_rules, secrets, simhash, suffix_dedup, toxicity


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py at the top of the repository, which imports this package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_decontaminate": decontaminate.query,
        "op2_html_extraction": html_extraction.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_toxicity": toxicity.query,
        "op5_pii": pii.query,
        "op6_language_model": language_model.query,
        "op7_quality_rules": quality_rules.query,
        "op8_secrets": secrets.query,
        "op9_best_fit_packing": best_fit_packing.query,
        "op10_simhash": simhash.query,
    }


def oracle_sql() -> dict:
    return {"op1_decontaminate": decontaminate.SQL}
