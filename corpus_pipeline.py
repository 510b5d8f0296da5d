"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame.  ``run`` applies them to the ``documents`` table, each result
written as Parquet and read again.  All but the last return the columns of
documents; each works on every row that its predecessor kept.

Defined cases, by stage.  Language: a null or letterless text has no language and goes; repeated rows are judged alike.
Near-duplicates: null texts do not get this far, texts without words link like any others; of equal rows one stays, a row
without an id only if its component has none with one.  Personal data: texts without entities stay as they are.  Mixing: a null source
is a source of its own, a document without an id is drawn by its text, one without words is as likely as its source's rate.
Packing: an empty text is its end token alone, copies of a document are documents of their own.  An empty table gives an empty
table of the same columns at every stage; columns that are not among ``documents``' are carried by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import crf, mixing, packing, pii, simhash
from tessera.llm.common import materialize, table

#: Documents below this mean probability of their language are rejected (with four languages a guess has 0.25).
LEAST_LANGUAGE_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (``und``) or with a very low score; ``lang`` becomes the predicted language."""
    labelled = crf.predict(docs, crf.learn(docs))
    kept = labelled.where((F.col("lang_pred") != crf.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of fingerprints within four bits: the one with the smallest id."""
    return simhash.keep_one(docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in ``text``; ``n_chars`` follows the new text."""
    replaced = pii.replace_pii(docs, pii.session_key(spark))
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says."""
    return mixing.emit(mixing.mix(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents; pieces with their token ids, and copies of a document as documents of their own."""
    tokens = materialize(packing.tokenize(docs, packing.default_tokenizer()), "pack-tokens")
    return packing.pack(tokens)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_duplicates", near_duplicate_stage),
    ("pii_surrogates", privacy_stage),
    ("mix_sources", mixing_stage),
    ("pack_hilbert", packing_stage),
]

#: A learned model and graph components are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
