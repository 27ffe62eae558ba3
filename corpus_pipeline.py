"""Training-corpus pipeline: identify, dedupe, cut repeats, mix and pack the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.

Nulls and edge cases, by stage: null, empty and letterless texts are in no
language and go with the first; rows equal in id and text are one after the
second, and of equal texts the least id stays, null ids last; rows that share
an id or have none lose no passage to each other in the third; a null source
is a source of its own in the fourth; the last cuts very long texts.  Other
columns, whatever their names, stay as they are until packing.  An empty table
stays empty.

Each stage bounds the session's Arrow batches (``BATCH_ROWS`` rows of whole
texts), as executors and their workers serve all stages one after another.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, mixing, packing, recompression, simhash
from graphloom.llm.common import bound_batches, materialize

#: Token pieces that a worker keeps: fewer than when packing alone, as the same workers serve all stages.
CACHE_PIECES = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; others go."""
    bound_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets have a similarity of 0.8 or more."""
    bound_batches(spark)
    return simhash.one_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that a smaller document has."""
    bound_batches(spark)
    return recompression.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    bound_batches(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_pieces=CACHE_PIECES)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the network nor tokenization; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
