"""From candidates to evidence: accept or reject with a reason, budget, order.

Candidate lists are bounded per query (top 25 plus named and sibling rows), so a
window per query is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators.ranking import top_per_group
from lectern.operators.retrieval import in_parent_scope, proper_topic


# ---- tests on one (query, chunk) row ----------------------------------------
def title_named(query: Column, doc_name: Column) -> Column:
    title = F.concat(F.lit(" "), F.array_join(T.tokens(doc_name), " "), F.lit(" "))
    phrases = T.word_phrases(T.content_terms(query), 2, 4)
    return (F.size(T.tokens(doc_name)) >= 2) & T.bind(
        title, lambda t: F.exists(phrases, lambda p: t.contains(F.concat(F.lit(" "), p, F.lit(" "))))
    )


def aligned(query: Column, clean: Column, min_token_len: int = 1) -> Column:
    """Some query term equals, contains or is inside a word of the evidence."""
    words = F.filter(T.token_set(clean), lambda w: F.length(w) >= min_token_len)
    return T.bind(
        words,
        lambda ws: F.exists(T.content_terms(query), lambda t: F.exists(ws, lambda w: w.contains(t) | t.contains(w))),
    )


def scope_mismatch(query: Column, doc_name: Column, target: Column) -> Column:
    """Reason when a chunk is outside the target document, else null."""
    wanted, name = F.lower(target), F.lower(F.coalesce(doc_name, F.lit("")))
    stem = F.regexp_replace(name, F.lit(r"\.[^/.]+$"), F.lit(""))
    active = wanted.isNotNull() & ~wanted.isin("", "null") & ~T.matches(query, fixed.CROSS_DOCUMENT)
    return F.when(
        active & ~name.contains(wanted) & ~wanted.contains(stem),
        F.concat(F.lit("Document mismatch: expected "), wanted, F.lit(", got "), name),
    )


# ---- selection --------------------------------------------------------------
def judged(candidates: DataFrame) -> DataFrame:
    """Every candidate with ``accepted`` and ``reject_reason``.

    Needs query_id, query, target_document, active_document, topic, chunk_id,
    doc_name, content, vector_score and parent_headings.
    """
    query = F.col("query")
    rows = (
        candidates.withColumn("clean", T.searchable_text(F.col("content")))
        .withColumn("searchable", F.length("clean") >= fixed.MIN_SEARCHABLE_CHARS)
        .withColumn("relevance", F.coalesce("vector_score", F.lit(0.0)))
        .withColumn("named", F.col("searchable") & title_named(query, F.col("doc_name")))
        .withColumn("parent_scope", in_parent_scope(F.col("parent_headings"), F.col("topic")))
    )
    each = Window.partitionBy("query_id")
    named_count = F.count_if("named").over(each)
    prefer = (named_count > 0) & ~(T.matches(query, fixed.SEVERAL_SOURCES) & (named_count < 2))
    best_named = F.max(F.when(F.col("named"), F.col("relevance"))).over(each)
    best_any = F.max(F.when(F.col("searchable"), F.col("relevance"))).over(each)
    rows = rows.withColumn("prefer_named", prefer).withColumn(
        "best", F.when(F.col("prefer_named"), best_named).otherwise(best_any)
    )
    scoped = F.coalesce(F.col("target_document").isNotNull() & (F.col("target_document") != ""), F.lit(False)) | F.col(
        "active_document"
    ).isNotNull()
    threshold = F.when(scoped, F.greatest(F.lit(0.05), F.col("best") * 0.3)).otherwise(
        F.greatest(F.lit(fixed.MIN_RELEVANCE), F.col("best") - 0.15)
    )
    rows = rows.withColumns({"scoped": scoped, "threshold": threshold})
    score = F.col("relevance")
    fits_words = aligned(query, F.col("clean"))
    fits = (
        F.col("parent_scope") | (score >= 0.35) | ((score >= 0.18) & fits_words) | (F.col("scoped") & fits_words)
    )
    topic = proper_topic(query)
    has_topic = topic.isNull() | F.lower("clean").contains(topic)
    reason = (
        F.when(~F.col("searchable"), "Chunk contains no searchable text")
        .when(F.col("prefer_named") & ~F.col("named"), "A document named in the query is preferred")
        .when(
            ~((score >= F.col("threshold")) | F.col("parent_scope")),
            F.concat(
                F.lit("Low embedding similarity ("), T.fixed_point(score, 3), F.lit(" < "), T.fixed_point(F.col("threshold"), 3), F.lit(")")
            ),
        )
        .otherwise(
            F.coalesce(
                scope_mismatch(query, F.col("doc_name"), F.col("target_document")),
                F.when(~has_topic, "Named topic is absent from the evidence"),
                F.when(~fits, "Evidence does not align with the current query"),
            )
        )
    )
    return rows.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def judged_by_overlap(candidates: DataFrame) -> DataFrame:
    """Selection without vectors: share of query words found in the chunk."""
    query_words, words = T.token_set(F.col("query")), T.token_set(F.col("content"))
    overlap = F.when(
        F.size(query_words) > 0, F.size(F.array_intersect(query_words, words)) / F.size(query_words)
    ).otherwise(F.lit(0.0))
    rows = candidates.withColumn("relevance", overlap).withColumn("named", title_named(F.col("query"), F.col("doc_name")))
    each = Window.partitionBy("query_id")
    named_count = F.count_if("named").over(each)
    prefer = (named_count > 0) & ~(T.matches(F.col("query"), fixed.SEVERAL_SOURCES) & (named_count < 2))
    rows = rows.withColumn("prefer_named", prefer)
    best = F.max(F.when(~F.col("prefer_named") | F.col("named"), F.col("relevance"))).over(each)
    scoped = F.col("target_document").isNotNull()
    floor = F.when(scoped, F.greatest(F.lit(0.12), best - 0.15)).otherwise(
        F.greatest(F.lit(fixed.MIN_RELEVANCE), best - 0.15)
    )
    rows = rows.withColumn("threshold", floor)
    return rows.withColumn(
        "accepted", (~F.col("prefer_named") | F.col("named")) & (F.col("relevance") >= F.col("threshold"))
    )


# ---- budget and order -------------------------------------------------------
def first_occurrences(rows: DataFrame, keys: list[str], identity: Column, order: str) -> DataFrame:
    """Rows that are the first of their identity within the keys."""
    place = F.row_number().over(Window.partitionBy(*keys, "__identity").orderBy(order))
    return rows.withColumn("__identity", identity).withColumn("__n", place).filter("__n = 1").drop("__identity", "__n")


def within_budget(rows: DataFrame, group: str, order: list[Column], tokens: int = fixed.EVIDENCE_TOKENS) -> DataFrame:
    """Leading rows whose text and name lengths fit the budget; the first row always stays.

    A row costs more than the fixed overhead, so no more than budget / overhead
    rows can fit: the list is cut there before it is summed, however long it is.
    """
    budget = tokens * fixed.CHARS_PER_TOKEN
    cost = F.length(F.coalesce("content", F.lit(""))) + F.length(F.coalesce("doc_name", F.lit(""))) + fixed.EVIDENCE_ROW_OVERHEAD
    possible = top_per_group(rows, [group], order, budget // fixed.EVIDENCE_ROW_OVERHEAD + 1, rank="place")
    running = F.sum("cost").over(Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return (
        possible.withColumn("cost", cost).withColumn("total_chars", running)
        .filter((F.col("total_chars") <= budget) | (F.col("place") == 1))
    )


def presentation_order(evidence: DataFrame) -> DataFrame:
    """Documents by first appearance, then chunk order, missing index last."""
    first_seen = F.min("rank").over(Window.partitionBy("query_id", "doc_id"))
    placed = evidence.withColumn("first_seen", first_seen)
    order = Window.partitionBy("query_id").orderBy("first_seen", F.asc_nulls_last("chunk_index"), "rank")
    return placed.withColumn("place", F.row_number().over(order))


def source_documents(evidence: DataFrame) -> DataFrame:
    """Distinct documents per query in first-seen order, as an array."""
    seen = evidence.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first_rank"))
    listed = F.sort_array(F.collect_list(F.struct("first_rank", "doc_id")))
    return seen.groupBy("query_id").agg(F.transform(listed, lambda x: x["doc_id"]).alias("doc_ids"))


def distinct_paragraphs(evidence: DataFrame) -> DataFrame:
    """Paragraphs of the evidence (query_id, doc_name, page, rank, pos, paragraph).

    Short ones go; of those with the same first fifty characters the first stays.
    """
    cut = (
        evidence.select("query_id", "doc_name", "page", "rank", F.posexplode(F.split("content", r"\n{2,}")).alias("pos", "p"))
        .withColumn("paragraph", T.trim_all(F.col("p"))).drop("p")
        .filter(F.length("paragraph") >= 10)
        .withColumn("start", F.lower(F.left("paragraph", F.lit(50))))
    )
    # Only the place of the first one is grouped; the text does not gather.
    firsts = cut.groupBy("query_id", "start").agg(F.min(F.struct("rank", "pos")).alias("f"))
    keys = firsts.select("query_id", "start", F.col("f.rank").alias("rank"), F.col("f.pos").alias("pos"))
    return cut.join(keys, ["query_id", "start", "rank", "pos"]).drop("start")


def evidence_document(evidence: DataFrame) -> DataFrame:
    """Evidence text by document and page (query_id, doc_name, page, first_rank, body)."""
    parts = distinct_paragraphs(evidence).withColumn(
        "paragraph", F.coalesce(T.numbered_list_from_line(F.col("paragraph")), F.col("paragraph"))
    )
    return parts.groupBy("query_id", "doc_name", "page").agg(
        F.min("rank").alias("first_rank"),
        F.expr("listagg(paragraph, '\\n\\n') WITHIN GROUP (ORDER BY rank, pos)").alias("body"),
    )


def complete_sections(evidence: DataFrame, headings: DataFrame) -> DataFrame:
    """Queries answered from all child sections: a parent heading and several section numbers."""
    numbered = evidence.groupBy("query_id").agg(F.count_distinct("section_number").alias("sections"))
    return numbered.filter("sections > 1").join(headings, "query_id")


def answer_or_fallback(generated: Column, prior: Column, evidence: Column) -> Column:
    """Generated text, else the prior answer, else the evidence text, else no evidence."""
    return F.coalesce(
        T.blank_to_null(generated), T.blank_to_null(prior), T.blank_to_null(evidence), F.lit(fixed.NO_EVIDENCE_ANSWER)
    )
