"""Registered queries of the text operators, with SQL checks where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from lectern.llm import budgets, codes, contamination, jaccard, language, licenses, lm, pieces, quality, rans, shards, sqlchecks, suffixes, whitening

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labels_or_none(spark: SparkSession, folder: str) -> DataFrame | None:
    """The labels table, if the folder has one."""
    try:
        return read(spark, folder, "labels")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


@query
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return jaccard.near_duplicates(read(spark, folder, "documents"))


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document."""
    return suffixes.dedup(read(spark, folder, "documents"))


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark phrases in every document."""
    return contamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


ORACLES["op3_decontamination"] = sqlchecks.decontamination(10)


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures and the likelihood-ratio verdict of every document."""
    docs, labels = read(spark, folder, "documents"), labels_or_none(spark, folder)
    ratios = quality.fit(docs, labels)
    return quality.judge(docs, ratios, quality.calibrated(docs, labels, ratios))


@query
def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, learned from six sevenths of them."""
    return lm.score(read(spark, folder, "documents"), language.id_remainder(7) == 2)


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Exact token counts of every document and which exceed 4,096."""
    return budgets.count_tokens(read(spark, folder, "documents"), public_tokenizers.path(MODEL))


@query
def op7_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and fuzzy notices of every document."""
    return licenses.scan(read(spark, folder, "documents"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = read(spark, folder, "documents")
    held_out = language.id_remainder(5) == 0
    return language.predict(docs, language.fit(docs.where(~held_out)), held_out)


@query
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every document."""
    return pieces.round_trips(read(spark, folder, "documents"), public_tokenizers.path(MODEL))


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document under law ``rows``."""
    return shards.shard(read(spark, folder, "documents"))


ORACLES["op10_sharding"] = sqlchecks.sharding(16, 20)


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product code and error of every vector."""
    found = codes.compress(read(spark, folder, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


ORACLES["op11_vector_codes"] = sqlchecks.vector_codes(4, 256, 4)


@query
def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, count and checksum of every document's ids, from files written and read back."""
    return rans.round_trip(read(spark, folder, "documents"), public_tokenizers.path(BYTE_MODEL))


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Four whitened components of every vector."""
    return whitening.whiten(read(spark, folder, "embeddings"))
