"""From raw documents to token ids: quality rules, near-duplicates, secrets, source mix, pieces.

Each stage reads all that the one before it kept, from Parquet, and its
decisions hold for the ones after it. What a stage has stored on its way goes when the next one begins; by then its result must be written.

A null text counts as empty: it has no words, so the quality rules let it go. Rows without an id, repeated ids and repeated rows are rows of
their own until near-duplicates leaves one of each group. Rows without a source form a source. Other columns, whatever
their names, go along up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coratia.llm import mixing, nearcopies, pieces, quality, secrets
from coratia.plans.lineage import Scope, fresh_path, freed_shuffles

# Where every executor's Spark can read the model; the file is never part of the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Rows that go to Python at once, at most; texts are long, and each of an executor's tasks holds a batch on both sides.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

# What the stage that began last has stored, by application.
_held: dict[str, Scope] = {}


def _freeing(stage: Stage) -> Stage:
    """The stage, which begins by deleting what the stage before it has stored."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        if application in _held:
            _held.pop(application).release()
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        with Scope(spark) as own:
            made = stage(spark, docs, sf_dir)
        _held[application] = own
        return made

    return run


@_freeing
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior of the votes reject go."""
    return quality.keep_good(docs)


@_freeing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word similarity of 0.8 or more) stays."""
    return nearcopies.drop_near_copies(docs)


@_freeing
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are blanked out; all documents stay."""
    return secrets.redact(docs)


@_freeing
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


@_freeing
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with what tells the document apart."""
    encoded = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), MODEL)
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("pieces", encode_pieces),
]

# SQL has no piece model and no XXH64; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        made = stage(spark, docs, sf_dir)
        with freed_shuffles(spark):
            made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
