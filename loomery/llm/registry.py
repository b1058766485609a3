"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, chat, embeddings, html_text, language_id, language_model, licenses, oracles, packing, pieces, quality, simhash, toxicity, vector_codes


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": _pipeline,
        "op1_license_scan": licenses.query,
        "op2_toxicity": toxicity.query,
        "op3_lm_scoring": language_model.query,
        "op4_quality_rules": quality.query,
        "op5_packing": packing.query,
        "op6_html_extraction": html_text.query,
        "op7_simhash_dedup": simhash.query,
        "op8_embedding_dedup": embeddings.query,
        "op9_sentencepiece": pieces.query,
        "op10_chat_formatting": chat.query,
        "op11_centroid_clustering": centroids.query,
        "op12_language_id": language_id.query,
        "op13_vector_codes": vector_codes.query,
    }


def oracle_sql():
    return {
        "op1_license_scan": oracles.license_scan(),
        "op4_quality_rules": oracles.quality_rules(),
        "op8_embedding_dedup": oracles.embedding_dedup(),
        "op10_chat_formatting": oracles.chat_formatting(),
        "op11_centroid_clustering": oracles.centroid_clusters(),
        "op13_vector_codes": oracles.vector_codes_sql(),
    }
