"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next stage's docs. The first four return the columns of
documents; the last returns doc_id, n_tokens, ids, score and round_trip.

Cases: a null or empty text, or one without a word, fails the first stage's base
rules. Columns beyond those of documents are left out. Rows that share a doc_id are
documents of their own until the second stage, which keeps one row of each group of
copies. Every stage gives an empty table for an empty one, and each module's
docstring says what it does with long texts and ties.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import contamination, jaccard, pieces, quality, suffixes
from lectern.llm.queries import MODEL, labels_or_none, read
from lectern.session import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    own, labels = docs.select(*COLUMNS), labels_or_none(spark, sf_dir)
    ratios = quality.fit(own, labels)
    return quality.keep(own, ratios, quality.calibrated(own, labels, ratios))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document holds; texts of which nothing is left go."""
    return suffixes.cut(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark phrase."""
    return contamination.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again to see that nothing is lost."""
    model = public_tokenizers.path(MODEL)
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text"), model), model)
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "score", (F.col("decoded") == plain).alias("round_trip")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Fingerprint samples, hashed ratios and byte spans are no SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is kept as a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
