"""A corpus pipeline over ``documents``: each stage works on all its predecessor kept.

Language identification, n-gram Jaccard join, secret scan, mixing and byte-level BPE, in this order. All stages but the
last return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.language_id import UNDETERMINED, identify
from loomgraph.llm.mixing import mix_order
from loomgraph.llm.ngram_join import keep_one_of_each, link_documents
from loomgraph.llm.q_op4 import round_trip_digests
from loomgraph.llm.q_op7 import learned_tables
from loomgraph.llm.secrets import find_secrets, redact, train_pair_ratios, training_samples
from loomgraph.runtime import materialize, sweep, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The uniform code: a text that no language's model codes below it is in none of them.
UNIFORM_BITS = 8.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the models know, with ``lang`` as predicted. Null texts, texts without a letter and
    those that every model finds less likely than random bytes go."""
    found = identify(docs, learned_tables(docs), keep=["text", "source", "n_chars"])
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") < UNIFORM_BITS))
    return kept.withColumnRenamed("lang_pred", "lang").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every component linked by five-word shingles at 0.8."""
    linked = link_documents(docs, width=5, num=80, den=100)
    return keep_one_of_each(docs, linked).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark."""
    found = find_secrets(docs.select(COLUMNS), train_pair_ratios(training_samples(spark, docs=docs)))
    text = redact(F.col("text"), F.concat("base_spans", "added_spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, from 0 to 3 times, in the order of virtual finish times."""
    return mix_order(docs, COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_to_targets),
    ("byte_bpe", encode),
]

#: SQL has no counterpart of the language models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder before the next reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        sweep(spark, since=before, keep=(docs,))  # what the stage wrote on its way, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
