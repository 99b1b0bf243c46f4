"""The corpus pipeline: raw documents to a mixed, tokenised training set.

STAGES in order: documents in no learned language go; lines of repeated runs,
and long lines that repeat, go from later copies, and documents that lose all
their lines with them; of each group of near-duplicates one document stays; sources are mixed to target
weights, with whole and partial repetitions; the texts are encoded. Each
function takes (spark, docs, sf_dir) and returns a frame; `run` writes it to
the shared folder and reads it again as the next stage's docs. All but the
last keep the columns of `documents`, `n_chars` brought up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.llm import hyperminhash, langid, line_dedup, mixing, sentencepiece_codec
from lossledger.llm.common import documents, written
from lossledger.llm.registry import PIECES


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, PIECES)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(line_dedup.deduplicated(docs, long_words=line_dedup.LONG_WORDS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(mixing.mixed(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identified),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The first stage is a model's decision, which SQL can't express; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
