"""The corpus pipeline: documents without toxic and near-duplicate ones and without secrets, mixed to target weights and encoded.

Every stage works on all that its predecessor kept; stages before the last
return the columns of documents.

* toxicity: documents that score 0.7 or more go.
* simhash: of each group of near-duplicates (5-word shingles with a Jaccard
  similarity of 0.8 or more, over chains) the document with the least id
  stays. Every link is verified on the whole shingle sets.
* secrets: every found secret is masked in the text.
* mixing: a document of an under-weighted language is repeated as its rate
  says; no document is lost.
* encoding: piece ids and decoded text of every row, as digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import materialise, read_table, remove, scratch
from lectern.llm.mixing import mixed_rows
from lectern.llm.piece_bpe import encode_decode
from lectern.llm.secret_scan import without_secrets
from lectern.llm.similar import one_of_each
from lectern.llm.toxicity import without_toxic

#: Target shares of tokens per language.
LANGUAGES = {"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.11}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domain = F.coalesce(*(F.when(F.col("lang") == name, k) for k, name in enumerate(LANGUAGES)))
    return mixed_rows(docs, docs.select("doc_id", "lang"), domain, list(LANGUAGES.values()))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's own tables are in a folder of its own, which goes with its input as soon as its result is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as own:
            made = stage(spark, docs, sf_dir)
            docs = materialise(made, path := f"{own}-result")
        for folder in filter(None, (own, before)):
            remove(spark, folder)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
