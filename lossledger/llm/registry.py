"""The corpus operators as queries: key -> function of (spark, sf_dir), and DuckDB SQL where SQL can say the same.

Each query applies one operator, with production parameters, to the whole
`documents` table. `TOKENIZERS` is the folder of the public vocabularies, the
same on driver and executors; the operators take the files' paths as parameters.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lossledger.llm import bpe_tree, exact_dedup, hyperminhash, imatch, langid, line_dedup, mixing, phrases, prefix_trie, sentencepiece_codec, sharding, suffix_dedup, token_counts
from lossledger.llm.common import documents

_PACKAGE = importlib.util.find_spec("public_tokenizers")
TOKENIZERS = os.path.dirname(_PACKAGE.origin) if _PACKAGE else "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(documents(spark, sf_dir), PIECES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), PIECES)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir), long_words=line_dedup.LONG_WORDS)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), BYTE_BPE)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir)).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.stability(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).drop("stratum", "key")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_digests(documents(spark, sf_dir), BYTE_BPE)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_line_dedup, op4_token_counts, op5_suffix_dedup, op6_sharding, op7_fingerprints, op8_mixing, op9_exact_dedup, op10_near_dedup, op11_phrases, op12_prefix_trie, op13_bpe, pipeline)}
SQL: dict[str, str] = {"op3_line_dedup": line_dedup.SQL, "op6_sharding": sharding.SQL, "op8_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL,
                       "op11_phrases": phrases.SQL, "op12_prefix_trie": prefix_trie.SQL}
