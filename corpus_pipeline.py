"""Cleaning of a document table in stages, each by one operator of the subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from gridmill.llm import bpe, decontaminate, langid, near_duplicates, toxicity
from gridmill.llm.common import named, private, saved, table

#: Ids up to this number (8 bytes each) are broadcast to drop rows; more are joined by shuffle.
BROADCAST_IDS = 1 << 20
VOCABULARY = "word_bpe_49k.json"


def _whole(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that writes its result and returns the table written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return saved(stage(spark, docs, sf_dir), stage.__name__)

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ids; null ids stay."""
    ids = saved(ids.select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*named(docs.columns))


def _order(docs: DataFrame) -> list[Column]:
    """All columns, those that have no order of their own as text."""
    plain = (ArrayType, MapType, StructType, VariantType)
    return [c.cast("string") if isinstance(docs.schema[n].dataType, plain) else c for n, c in zip(docs.columns, named(docs.columns), strict=True)]


@_whole
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and those without a letter."""
    return langid.with_language(docs, langid.prototypes(docs))


@_whole
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorization machine takes for toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_whole
def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    The smallest id stays; of rows that share an id, the first by all columns."""
    groups = saved(near_duplicates.near_duplicates(docs, width=5, percent=80), "groups")
    repeated = saved(groups.where("doc_id is not null and kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    dropped = groups.where(~F.col("kept")).select("doc_id")
    rest = _without(docs, dropped.unionByName(repeated))
    (place,) = private(docs, "place")
    one = docs.join(repeated, "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(*_order(docs))))
    return rest.unionByName(one.where(F.col(place) == 1).select(*named(docs.columns)))


@_whole
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


@_whole
def codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("toxicity", toxic), ("near duplicates", duplicates), ("decontamination", benchmark), ("codes", codes)]

#: Learned models and alignments are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its result and reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
