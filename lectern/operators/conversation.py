"""Conversations: history windows, carry-over, prior answers, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T


def owned_artifacts(artifacts: DataFrame, conversations: DataFrame, user: str) -> DataFrame:
    """Artifacts whose conversation belongs to the user, in the same tenant."""
    mine = conversations.filter(F.col("user_id") == user).select("conversation_id", "org_id")
    return artifacts.filter(F.col("org_id").isNotNull()).join(mine, ["conversation_id", "org_id"])


def checked_title(updates: DataFrame) -> DataFrame:
    """Rename requests with the reason for refusal, null when fine."""
    title = T.collapse(F.coalesce("title", F.lit("")))
    return updates.withColumn("title", title).withColumn(
        "reject_reason",
        F.when(F.col("title") == "", "Conversation name cannot be empty.").when(
            F.length("title") > 80, "Conversation name must be 80 characters or fewer."
        ),
    )


# ---- history ----------------------------------------------------------------
def last_messages(messages: DataFrame, n: int, order: str = "turn") -> DataFrame:
    """Newest ``n`` messages of each conversation, to be read oldest first."""
    from lectern.operators.ranking import top_per_group

    return top_per_group(messages, ["conv_id"], [F.desc(order)], n).drop("rank")


def latest_row(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Newest row per group by aggregation, so a large group never gathers."""
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def usable_answer() -> Column:
    """An assistant message that can be built upon."""
    return (
        (F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) != "") & F.col("answer_id").isNotNull()
        & ~F.col("content").rlike(fixed.DELIVERY_NOTE)
    )


def with_prior_answer(messages: DataFrame, bucket_size: int = 1024) -> DataFrame:
    """Each message with the latest usable answer before it (as-of lookup)."""
    from lectern.operators.split_windows import last_before

    answer = F.when(usable_answer(), F.struct("message_id", "answer_id", "turn"))
    out = last_before(
        messages, ["conv_id"], F.col("turn"), F.floor(F.col("turn") / bucket_size), {"prior": answer}
    )
    return out


def with_history(messages: DataFrame, n: int = fixed.HISTORY_TURNS, bucket_size: int = 1024) -> DataFrame:
    """Each message with its ``n`` predecessors as an array, oldest first."""
    from lectern.operators.split_windows import positions, recent_rows

    placed = positions(messages, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / bucket_size))
    row = F.struct(
        "message_id", "answer_id", "turn", "role", "content", "topic", "source_doc_ids",
        T.token_set(F.col("content")).alias("words"),
    )
    return recent_rows(placed, ["conv_id"], "position", n, row, "history", bucket_size)


def is_usable(m: Column) -> Column:
    return (
        (m["role"] == "assistant") & (m["content"] != "") & m["answer_id"].isNotNull()
        & ~m["content"].rlike(fixed.DELIVERY_NOTE)
    )


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def with_past_scope(turns: DataFrame, documents: DataFrame) -> DataFrame:
    """``past_document`` and ``past_topic`` of each turn, from its history.

    The nearest assistant turn with sources decides the document even when that
    document is gone; a topic is looked for further back until one is found.
    """
    sourced = _last(F.filter("history", lambda m: (m["role"] == "assistant") & (F.size(m["source_doc_ids"]) > 0)))
    topical = _last(
        F.filter("history", lambda m: (m["role"] == "assistant") & m["answer_id"].isNotNull() & (F.coalesce(m["topic"], F.lit("")) != ""))
    )
    stem = F.lower(F.regexp_replace("doc_name", F.lit(r"\.[^/.]+$"), F.lit("")))
    # A turn without a document meets none, under a key of its own: a null key would send all such turns to one task.
    doc = F.get(sourced["source_doc_ids"], F.lit(0))
    key = F.coalesce(F.concat(F.lit("d"), doc), F.concat(F.lit("m"), F.coalesce("message_id", F.lit(""))))
    names = documents.select(F.concat(F.lit("d"), "doc_id").alias("_doc"), stem.alias("past_document"))
    df = turns.withColumns({"_doc": key, "past_topic": topical["topic"]})
    return df.join(names, "_doc", "left").drop("_doc")


def with_carried_scope(turns: DataFrame) -> DataFrame:
    """Inherit document and topic on follow-ups; a new topic starts clean."""
    new_topic = (
        (F.col("context_type") == "NEW_TOPIC") | F.col("relation").isin("NEW_TOPIC", "NONE") | F.col("new_information")
    )
    follows = (
        (F.col("context_type") == "CURRENT_ANSWER") | F.col("relation").isin("CONTINUE", "TRANSFORM", "MODIFY", "REPRESENT")
        | T.matches(F.col("query"), fixed.FOLLOW_UP)
    )
    return turns.withColumns(
        {
            "target_document": F.coalesce("target_document", F.when(~new_topic, F.col("past_document"))),
            "topic": F.coalesce("topic", F.when(follows, F.col("past_topic"))),
        }
    )


def with_best_context(turns: DataFrame) -> DataFrame:
    """The earlier answer a turn builds on, as ``context`` (struct of a history message) or null.

    Needs history, query, topic, relation, new_information and wanted_answer_id.
    """
    pool = F.filter("history", is_usable)
    last_assistant = _last(F.filter("history", lambda m: (m["role"] == "assistant") & (m["content"] != "")))
    asked = T.token_set(F.concat_ws(" ", "query", F.coalesce("topic", F.lit(""))))
    df = turns.withColumns({"_pool": pool, "_asked": asked, "_blocked": T.matches(last_assistant["content"], fixed.NO_EVIDENCE)})
    df = df.withColumn(
        "_exact",
        F.get(
            F.filter("_pool", lambda m: (m["message_id"] == F.col("wanted_answer_id")) | (m["answer_id"] == F.col("wanted_answer_id"))),
            F.lit(0),
        ),
    )
    # Best score; the earlier message among equals.
    scored = F.transform(
        "_pool",
        lambda m, i: F.struct(
            (T.word_set_cosine(F.col("_asked"), m["words"]) * 0.8 + (i + 1) / F.size("_pool") * 0.2).alias("score"),
            (-i).alias("place"),
        ),
    )
    df = df.withColumn("_best", F.array_max(scored))
    best = F.get("_pool", -F.col("_best.place"))
    latest = _last(F.col("_pool"))
    follows = F.col("relation").isin("CONTINUE", "TRANSFORM", "MODIFY", "REPRESENT", "DOWNLOAD")
    choice = (
        F.when(F.coalesce("_blocked", F.lit(False)) | (F.size("_pool") == 0), F.lit(None))
        .when(F.col("_exact").isNotNull(), F.col("_exact"))
        .when(F.col("new_information"), F.lit(None))
        .when(F.col("relation").isNull(), latest)
        .when(follows, F.when(F.col("_best.score") >= 0.3, best).otherwise(latest))
        .when(F.col("_best.score") >= 0.35, best)
    )
    return df.withColumn("context", choice).withColumn("context_score", F.round("_best.score", 6)).drop(
        "_pool", "_asked", "_blocked", "_exact", "_best"
    )


# ---- conversation rows ------------------------------------------------------
def conversation_rows(messages: DataFrame) -> DataFrame:
    """Conversation row rebuilt from its messages: last message, first question as title."""
    first_question = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(
        F.max_by("message_id", "turn").alias("last_message_id"),
        F.count(F.lit(1)).alias("messages"),
        F.left(T.trim_all(first_question), F.lit(80)).alias("default_title"),
    )


def appended_messages(stored: DataFrame, conversations: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append messages and touch their conversations; a title set by the user stays."""
    both = stored.unionByName(incoming)
    touched = conversation_rows(both)
    rows = conversations.select("conv_id", "title").join(touched, "conv_id", "right")
    title = F.coalesce(T.blank_to_null(T.trim_all(F.col("title"))), F.col("default_title"))
    return both, rows.select("conv_id", title.alias("title"), "last_message_id", "messages")


def summaries_due(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Conversations with eight messages more than their summary version covers."""
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
    versions = summaries.groupBy("conv_id").agg(F.max("version").alias("version"))
    joined = counts.join(versions, "conv_id", "left").withColumn("version", F.coalesce("version", F.lit(0)))
    return joined.withColumn("due", F.col("messages") >= (F.col("version") + 1) * fixed.SUMMARY_EVERY)


def attached_artifacts(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """Set the source message of the listed artifacts (links: artifact_ids, message_id)."""
    pairs = links.select(F.explode("artifact_ids").alias("artifact_id"), "message_id").groupBy("artifact_id").agg(
        F.max("message_id").alias("new_message_id")
    )
    return artifacts.join(pairs, "artifact_id", "left").withColumn(
        "source_message_id", F.coalesce("new_message_id", "source_message_id")
    ).drop("new_message_id")


def history_view(messages: DataFrame, artifacts: DataFrame, documents: DataFrame) -> DataFrame:
    """Messages with their artifacts (linked or listed by id, once each) and source documents.

    Sources that are no longer in the catalog are dropped; order is kept.
    """
    linked = artifacts.select(F.col("source_message_id").alias("message_id"), "artifact_id", F.lit(0).alias("origin"), F.lit(0).alias("pos"))
    listed = (
        messages.select("message_id", F.posexplode("artifact_ids").alias("pos", "artifact_id"))
        .join(artifacts.select("artifact_id"), "artifact_id", "left_semi")
        .select("message_id", "artifact_id", F.lit(1).alias("origin"), "pos")
    )
    once = linked.unionByName(listed).groupBy("message_id", "artifact_id").agg(F.min(F.struct("origin", "pos")).alias("at"))
    per_message = once.groupBy("message_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "artifact_id"))), lambda x: x["artifact_id"]).alias("artifacts")
    )
    sources = source_names(messages.select("message_id", "source_doc_ids"), documents)
    return messages.join(per_message, "message_id", "left").join(sources, "message_id", "left")


def source_names(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Names of the source documents per message, in the order of the ids, unknown ids dropped."""
    ids = rows.select("message_id", F.posexplode("source_doc_ids").alias("pos", "doc_id"))
    named = ids.join(documents.select("doc_id", "doc_name"), "doc_id")
    return named.groupBy("message_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_name"))), lambda x: x["doc_name"]).alias("source_names")
    )


def artifact_to_download(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Newest artifact of the wanted format, or the newest of all when none is named."""
    per_format = artifacts.groupBy("conv_id", "format").agg(F.max_by("artifact_id", "created_at").alias("artifact_id"))
    newest = artifacts.groupBy("conv_id").agg(F.max_by("artifact_id", "created_at").alias("newest_id"))
    out = requests.join(
        per_format.select("conv_id", F.col("format").alias("requested_format"), "artifact_id"), ["conv_id", "requested_format"], "left"
    ).join(newest, "conv_id", "left")
    return out.withColumn(
        "artifact_id", F.when(F.col("requested_format").isNull(), F.col("newest_id")).otherwise(F.col("artifact_id"))
    ).drop("newest_id")


def conversation_list(conversations: DataFrame, limit: int = 50) -> DataFrame:
    """Pinned first, then newest, at most ``limit`` (the page size)."""
    return conversations.orderBy(F.desc("is_pinned"), F.desc("updated_at"), F.desc("conv_id")).limit(limit)


# ---- prompts ----------------------------------------------------------------
def grounded_prompts(turns: DataFrame, evidence: DataFrame) -> DataFrame:
    """Prompt text per turn: rules, evidence in order, recent turns, summary, charts, question.

    Evidence is bounded by the token budget and history by its turn count.
    """
    block = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.col("doc_name"), F.lit("\n"), F.col("content"))
    blocks = (
        evidence.withColumn("block", block).groupBy("query_id")
        .agg(F.expr("listagg(block, '\\n\\n') WITHIN GROUP (ORDER BY place)").alias("evidence"))
    )
    recent = F.array_join(
        F.transform(
            F.slice("history", F.greatest(F.size("history") - 15, F.lit(1)), F.lit(16)),
            lambda m: F.concat(m["role"], F.lit(": "), F.left(m["content"], F.lit(1200))),
        ),
        "\n",
    )
    prompt = F.concat_ws(
        "\n\n",
        F.lit("Answer only from the evidence. Say so when it is not enough."),
        F.concat(F.lit("Evidence:\n"), F.coalesce("evidence", F.lit("(none)"))),
        F.concat(F.lit("Conversation:\n"), T.blank_to_null(recent)),
        F.concat(F.lit("Summary:\n"), F.col("summary")),
        F.concat(F.lit("Charts:\n"), F.col("charts_json")),
        F.concat(F.lit("Question: "), F.col("query")),
    )
    return turns.join(blocks, "query_id", "left").withColumn("prompt", prompt).withColumn(
        "prompt_tokens", T.token_estimate(F.col("prompt"))
    )
