"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, crf, ctph, html_text, licenses, mixing, orchard, packing, pii, simhash, toxicity, warc, whitening
from tessera.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op9_mix_sources": mixing.ORACLE_SQL}


def _query(fn, *tables: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(*[table(spark, sf_dir, t) for t in tables])

    QUERIES[fn.__name__] = run


_query(simhash.op1_simhash_bk, "documents")
_query(packing.op2_pack_hilbert, "documents")
_query(pii.op3_pii_surrogates, "documents")
_query(ctph.op4_ctph, "documents")
_query(crf.op5_language_crf, "documents")
_query(html_text.op6_html_suffix_array, "pages")
_query(warc.op7_warc_zstd, "pages")
_query(toxicity.op8_toxicity_grammar, "documents", "labels")
_query(mixing.op9_mix_sources, "documents")
_query(ann.op10_ann_kmeans_tree, "embeddings")
_query(orchard.op11_orchard_clusters, "embeddings")
_query(whitening.op12_whitening_qr, "embeddings")
_query(licenses.op13_license_rules, "documents")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
