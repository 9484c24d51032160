"""Is an answer carried by its evidence?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators.vectors import top_similar


def sentence_support(sentences: DataFrame, evidence: DataFrame, skip_same_id: bool = False) -> DataFrame:
    """Best similarity of each sentence to any evidence of its answer.

    Sentences (answer_id, sentence_id, vector) and evidence (answer_id,
    evidence_id, vector) meet in blocks; each block reports one best row.
    """
    # With the sentence itself among the evidence, the two best rows hold the best other one.
    k = 2 if skip_same_id else 1
    q = sentences.select("answer_id", F.col("sentence_id").alias("query_id"), "vector")
    items = evidence.select("answer_id", F.col("evidence_id").alias("item_id"), "vector")
    best = top_similar(q, items, k, group="answer_id")
    if skip_same_id:
        best = best.filter("query_id <> item_id")
    best = best.groupBy(F.col("query_id").alias("sentence_id")).agg(F.max("score").alias("best"))
    return sentences.select("answer_id", "sentence_id").join(best, "sentence_id")


def grounded_answers(
    sentences: DataFrame, evidence: DataFrame, skip_same_id: bool = False,
    floor: float = fixed.GROUNDING_SENTENCE, share: float = fixed.GROUNDING_SHARE,
) -> DataFrame:
    """Share of supported sentences per answer and the verdict."""
    support = sentence_support(sentences, evidence, skip_same_id)
    counted = support.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("best") >= floor).alias("passing")
    )
    ratio = F.col("passing") / F.col("sentences")
    return counted.withColumns({"share": F.round(ratio, 6), "grounded": ratio >= share})


def answer_verdicts(answers: DataFrame, evidence: DataFrame, embed) -> DataFrame:
    """Verdict per answer (answer_id, answer): no evidence is false, no claim left is true.

    ``embed`` turns a text column into a vector column. When it fails for a row
    (null vector) the verdict is null with a note, never a silent pass.
    """
    claims = answers.select("answer_id", F.posexplode(T.claim_sentences(F.col("answer"))).alias("n", "sentence")).select(
        "answer_id", F.xxhash64("answer_id", "n").alias("sentence_id"), embed(F.col("sentence")).alias("vector")
    )
    proof = evidence.select(
        "answer_id", F.xxhash64("answer_id", "evidence_id").alias("evidence_id"), embed(F.col("text")).alias("vector")
    )
    broken = (
        claims.filter("vector is null").select("answer_id")
        .union(proof.filter("vector is null").select("answer_id")).distinct().withColumn("broken", F.lit(True))
    )
    checked = grounded_answers(claims.filter("vector is not null"), proof.filter("vector is not null")).select(
        "answer_id", "share", "grounded"
    )
    has_proof = evidence.select("answer_id").distinct().withColumn("has_evidence", F.lit(True))
    joined = answers.join(has_proof, "answer_id", "left").join(checked, "answer_id", "left").join(broken, "answer_id", "left")
    no_answer = F.coalesce(F.length("answer"), F.lit(0)) == 0
    return joined.select(
        "answer_id", "share",
        F.when(no_answer | F.col("has_evidence").isNull(), False)
        .when(F.col("broken"), F.lit(None).cast("boolean"))
        .otherwise(F.coalesce("grounded", F.lit(True)))
        .alias("grounded"),
        F.when(F.col("broken"), "no vector for a sentence or its evidence").alias("error"),
    )
