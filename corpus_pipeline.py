"""The corpus pipeline: filter, deduplicate twice, mix, pack. Each stage's rows are written and read again.

Defined results, for all stages: a null or empty text is not toxic, equals other empty texts, has no words to mix and
packs as its end alone, where it gets so far; null ids, languages, sources and lengths are carried; of rows that repeat,
one outlives exact deduplication; an empty table gives empty tables; columns beyond those of documents, whatever
their names, are carried up to packing, which gives its own.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.exact_dedup import deduplicated
from pagewright.llm.mixing import mixed_documents
from pagewright.llm.near_join import near_deduplicated
from pagewright.llm.packing import pack
from pagewright.llm.shared import documents, drop, keep, small_batches, tables
from pagewright.llm.toxicity import not_toxic

#: No SQL can express the classifier, the sampled join or the tokenizer.
ORACLE_SQL = None
#: What the last stage has kept; a stage's rows are written before the next one is called, which so may delete it.
_kept: list[str] = []


def stage(step):
    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _kept)
        small_batches(spark)  # stays set, as a stage's rows are made after it has returned
        with tables() as made:
            out = step(spark, docs, sf_dir)
        _kept[:] = made
        return out

    return run_stage


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return deduplicated(docs)


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_deduplicated(docs)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the sources' target shares, repeated or cut as the mixture takes them."""
    return mixed_documents(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept, and its predecessor's rows, are deleted once its rows are written."""
    docs, before = documents(spark, sf_dir), []
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with tables() as written:
                docs = keep(docs, name)
            drop(spark, before)
            before = written
    return docs
