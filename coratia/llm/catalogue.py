"""The queries of this subpackage on the given tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coratia.llm import (
    language,
    merkle,
    mining,
    mixing,
    neighbours,
    pieces,
    positive,
    preferences,
    quality,
    secrets,
    sharding,
    simhash,
    warc,
)
from coratia.llm.sql import SQL as SQL

# The piece model: a path that Spark can read.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(_table(spark, folder, "documents"), MODEL)


@_query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(_table(spark, folder, "pages"))


@_query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


@_query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, folder, "documents")))


@_query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


@_query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.layout(_table(spark, folder, "documents"))


@_query
def op8_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.preference_rows(preferences.answer_pairs(_table(spark, folder, "conversations")))


@_query
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(_table(spark, folder, "embeddings"), neighbours.every(50))


@_query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return judged.withColumn("p_good", F.round("p_good", 6))


@_query
def op11_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return positive.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.check(_table(spark, folder, "documents"))


@_query
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return mining.mine(_table(spark, folder, "embeddings"))
