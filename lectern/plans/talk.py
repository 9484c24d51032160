"""Queries over conversations, routing and row updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import routing as R
from lectern.functions import text as T
from lectern.operators import conversation as C
from lectern.operators import updates as U
from lectern.plans import derived as D
from lectern.plans import sqltext as S
from lectern.plans.registry import query, table

M = S.messages()
USABLE = f"(role = 'assistant' AND content <> '' AND answer_id IS NOT NULL AND NOT {S.has('content', fixed.DELIVERY_NOTE, '')})"


# ---- history ----------------------------------------------------------------
@query("last_turns", "WIN-1", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def last_turns(spark, folder):
    return C.last_messages(table(spark, folder, "conversations"), 3).select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query(
    "latest_rows", "WIN-2 UPD-8",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS "at", count(*) AS events FROM events GROUP BY user_id""",
)
def latest_rows(spark, folder):
    return U.latest_status(table(spark, folder, "events"), "user_id", "ts", "event_type", "event_id")


@query(
    "prior_answers", "JOIN-8",
    f"""SELECT message_id, last_value(CASE WHEN {USABLE} THEN answer_id END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_answer FROM {M}""",
)
def prior_answers(spark, folder):
    return C.with_prior_answer(D.messages(spark, folder)).select("message_id", F.col("prior.answer_id").alias("prior_answer"))


@query(
    "source_names", "JOIN-10",
    f"""SELECT m.message_id, d.doc_name AS source_names FROM {M} m JOIN {S.DOCS} d ON d.doc_id = m.source_doc""",
)
def source_names(spark, folder):
    return C.source_names(D.messages(spark, folder), D.docs(spark, folder)).select(
        "message_id", F.array_join("source_names", ",").alias("source_names")
    )


@query(
    "history_view", "JOIN-9",
    f"""WITH art AS (SELECT o_orderkey AS artifact_id, concat('m', o_custkey % 200, '_', o_orderkey % 4) AS source_message_id FROM orders),
        link AS (SELECT source_message_id AS message_id, artifact_id FROM art
                 UNION SELECT message_id, conv_id * 3 + turn FROM {M} WHERE conv_id * 3 + turn IN (SELECT artifact_id FROM art)),
        per AS (SELECT message_id, count(*) AS artifacts, CAST(sum(artifact_id) AS BIGINT) AS artifact_sum FROM link GROUP BY message_id)
        SELECT m.message_id, coalesce(p.artifacts, 0) AS artifacts, p.artifact_sum, d.doc_name AS source_names FROM {M} m LEFT JOIN per p ON p.message_id = m.message_id LEFT JOIN {S.DOCS} d ON d.doc_id = m.source_doc""",
)
def history_view(spark, folder):
    artifacts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("artifact_id"),
        F.concat(F.lit("m"), F.col("o_custkey") % 200, F.lit("_"), F.col("o_orderkey") % 4).alias("source_message_id"),
    )
    messages = D.messages(spark, folder).withColumn("artifact_ids", F.array(F.col("conv_id") * 3 + F.col("turn")))
    view = C.history_view(messages, artifacts, D.docs(spark, folder))
    return view.select(
        "message_id", F.coalesce(F.size("artifacts").cast("bigint"), F.lit(0)).alias("artifacts"),
        F.aggregate("artifacts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("artifact_sum"),
        F.array_join("source_names", ",").alias("source_names"),
    ).withColumn("artifacts", F.greatest("artifacts", F.lit(0)))


@query(
    "conversation_rows", "WIN-14 UPD-1",
    f"""SELECT conv_id, arg_max(message_id, turn) AS last_message_id, count(*) AS messages,
        left({S.trim_all("arg_min(content, turn) FILTER (WHERE role = 'user')")}, 80) AS default_title FROM {M} GROUP BY conv_id""",
)
def conversation_rows(spark, folder):
    return C.conversation_rows(D.messages(spark, folder))


@query(
    "appended_messages", "UPD-1 UPD-3",
    f"""WITH t AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN concat('Named ', conv_id) WHEN conv_id % 3 = 1 THEN '  ' END AS title FROM {M} WHERE turn < 2 GROUP BY conv_id)
        SELECT m.conv_id, coalesce(nullif({S.trim_all('any_value(t.title)')}, ''), left({S.trim_all("arg_min(content, turn) FILTER (WHERE role = 'user')")}, 80)) AS title,
          arg_max(message_id, turn) AS last_message_id, count(*) AS messages FROM {M} m LEFT JOIN t ON t.conv_id = m.conv_id GROUP BY m.conv_id""",
)
def appended_messages(spark, folder):
    every = D.messages(spark, folder)
    stored, incoming = every.filter("turn < 2"), every.filter("turn >= 2")
    title = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Named "), F.col("conv_id"))).when(F.col("conv_id") % 3 == 1, F.lit("  "))
    conversations = stored.select("conv_id").distinct().withColumn("title", title)
    return C.appended_messages(stored, conversations, incoming)[1]


@query(
    "summary_due", "AGG-6",
    """WITH s AS (SELECT conv_id, max(turn) // 4 AS version FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
       SELECT c.conv_id, count(*) AS messages, CAST(coalesce(any_value(s.version), 0) AS BIGINT) AS version, count(*) >= 8 * (coalesce(any_value(s.version), 0) + 1) AS due
       FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id""",
)
def summary_due(spark, folder):
    messages = table(spark, folder, "conversations")
    summaries = messages.filter("role = 'assistant'").select("conv_id", F.floor(F.col("turn") / 4).alias("version"))
    return C.summaries_due(messages, summaries)


@query(
    "conversation_list", "TOP-5",
    """SELECT conv_id, is_pinned, updated_at FROM (SELECT conv_id, conv_id % 7 = 0 AS is_pinned, max(turn) AS updated_at FROM conversations GROUP BY conv_id)
       ORDER BY is_pinned DESC, updated_at DESC, conv_id DESC LIMIT 50""",
)
def conversation_list(spark, folder):
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    return C.conversation_list(rows.withColumn("is_pinned", F.col("conv_id") % 7 == 0)).select("conv_id", "is_pinned", "updated_at")


# ---- routing ----------------------------------------------------------------
LOW = f"lower({S.trim_all('content')})"
FLAGS = f"""(SELECT *, {S.has('low', fixed.DELIVERY_VERB, '')} AND asked_format IS NOT NULL AS delivery,
    {S.has('low', fixed.CONTEXT_DIAGRAM, '')} AND {S.has('low', fixed.CONTEXT_REFERENCE, '')} AS context_diagram,
    {S.has('low', fixed.ELABORATE_VERB, '')} AND {S.has('low', fixed.ELABORATE_TARGET, '')} AS elaboration,
    {S.has('low', fixed.KNOWLEDGE_VERB, '')} AND NOT {S.has('low', fixed.DEICTIC, '')} AND regexp_replace({S.rep('low', fixed.KNOWLEDGE_FILLER, ' ')}, '[^a-z0-9]+', '', 'g') <> '' AS new_knowledge,
    asked_format IS NOT NULL AND ({S.has('low', fixed.ANSWER_REFERENCE, '')} OR regexp_replace({S.rep(S.rep(S.rep('low', fixed.OUTPUT_WORDS[0], ' ', 'i'), fixed.OUTPUT_WORDS[1], ' ', 'i'), fixed.OUTPUT_WORDS[2], ' ', 'i')}, '[^a-z0-9]+', '', 'g') = '') AS answer_artifact,
    CASE WHEN asked_format = 'pptx' THEN 'presentation' WHEN theme = 'executive' THEN 'executive_summary' WHEN theme = 'technology' THEN 'technical_report' WHEN theme = 'minimal' THEN 'simple_document' ELSE 'professional_report' END AS template
    FROM (SELECT *, {S.rules('low', fixed.FORMAT_RULES)} AS asked_format, {S.rules('low', fixed.THEME_RULES, "'professional'")} AS theme,
      {S.rules('low', fixed.PALETTE_RULES, "'auto'")} AS palette,
      CASE WHEN {S.rules('low', fixed.FORMAT_RULES)} = 'svg' THEN {S.rules('low', fixed.VISUAL_RULES, "'hierarchy'")} END AS visual_type
      FROM (SELECT message_id, conv_id, turn, content AS query, {LOW} AS low FROM {M} WHERE role = 'user')))"""


def user_turns(spark, folder):
    return D.messages(spark, folder).filter("role = 'user'").select("message_id", "conv_id", "turn", F.col("content").alias("query"))


@query(
    "turn_flags", "RTE-1 RTE-2 RTE-3 RTE-6",
    f"SELECT message_id, asked_format, theme, palette, template, visual_type, delivery, context_diagram, elaboration, new_knowledge, answer_artifact FROM {FLAGS}",
)
def turn_flags(spark, folder):
    return R.with_turn_flags(user_turns(spark, folder)).select(
        "message_id", "asked_format", "theme", "palette", "template", "visual_type", "delivery", "context_diagram",
        "elaboration", "new_knowledge", "answer_artifact",
    )


WORDS_ASKED = f"TRY_CAST(nullif(regexp_extract(content, {S.sql_re2('(?i)' + fixed.WORD_COUNT)}, 1), '') AS INTEGER)"
POINTERS = "(this|that|it|these|those|the above|previous|current)"
NEW_TOPIC_VERB = r"\b(explain|describe|what|why|how|which|define|tell|compare) \b"
LOCAL = f"""(SELECT message_id, conv_id, turn, content, words, {S.has('low', fixed.SUMMARISE, '')} OR words IS NOT NULL AS local, {S.has('low', fixed.PRONOUN, '')} AS pronoun,
      regexp_matches(regexp_replace(low, ' {POINTERS}', ' #', 'g'), {S.sql_re2(NEW_TOPIC_VERB)}) AS verb
      FROM (SELECT *, lower(content) AS low, CASE WHEN n BETWEEN 1 AND 2000 THEN n END AS words FROM (SELECT *, {WORDS_ASKED} AS n FROM {M} WHERE role = 'user')))"""


@query(
    "local_context_turns", "RTE-4 TXT-8",
    f"""SELECT message_id, words, local OR (pronoun AND NOT verb) AS is_local, local AS is_summary,
        CASE WHEN verb AND NOT local THEN 'Explicit new topic question' WHEN local THEN 'Summarization or transformation intent detected'
             WHEN pronoun THEN 'Deictic pronoun reference detected' ELSE 'No local reference detected' END AS reason FROM {LOCAL}""",
)
def local_context_turns(spark, folder):
    return user_turns(spark, folder).withColumn("c", R.local_context(F.col("query"))).select(
        "message_id", T.explicit_word_count(F.col("query")).alias("words"), "c.is_local", "c.is_summary", "c.reason"
    )


@query(
    "retrieval_bypass", "RTE-5 RTE-13",
    f"""WITH p AS (SELECT message_id, role, last_value(CASE WHEN {USABLE} THEN content END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {M})
        SELECT l.message_id, (local OR (pronoun AND NOT verb)) AND length({S.trim_all("coalesce(p.prior, '')")}) > 50 AS bypass,
          {S.has('content', fixed.CHART_WORD)} AND ({S.has('content', fixed.CHART_POINTER)} OR length(content) < 50) AS chart_reference
        FROM {LOCAL} l JOIN p ON p.message_id = l.message_id""",
)
def retrieval_bypass(spark, folder):
    from lectern.operators.split_windows import last_before

    text = F.when(C.usable_answer(), F.col("content"))
    turns = last_before(D.messages(spark, folder), ["conv_id"], F.col("turn"), F.floor(F.col("turn") / 1024), {"prior": text})
    query_text = F.col("content")
    return turns.filter("role = 'user'").select(
        "message_id",
        R.bypasses_retrieval(R.local_context(query_text)["is_local"], F.col("prior"), F.lit(None).cast("string")).alias("bypass"),
        R.refers_to_chart(query_text).alias("chart_reference"),
    )


# The scope of a turn is found as in query_document_scope; here from the first words of the openings.
INTENT = f"""(WITH f AS (SELECT f.*, p.prior IS NOT NULL AS has_answer, f.conv_id % 2 = 0 AS has_artifact,
      CASE WHEN contains(query, 'en src') THEN 'en src' END AS scope, CAST(NULL AS VARCHAR) AS subject FROM {FLAGS} f JOIN
      (SELECT message_id, last_value(CASE WHEN role = 'assistant' AND answer_id IS NOT NULL THEN answer_id END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS prior FROM {M}) p ON p.message_id = f.message_id),
    g AS (SELECT *, {S.has('low', fixed.CREATION_VERB, '')} AS creates, asked_format IS NOT NULL AND {S.has('low', fixed.KNOWLEDGE_REQUEST, '')} AS both_, answer_artifact AND has_answer AS art FROM f),
    h AS (SELECT *, NOT creates AND {S.has('low', fixed.FETCH_VERB, '')} AND has_answer AND has_artifact AS download, NOT art AND context_diagram AND has_answer AS dia,
      has_answer AND NOT {S.has('low', fixed.NAMED_SUBJECT, '')} AND NOT both_ AND ({S.has('low', fixed.TRANSFORM_REQUEST, '')} OR asked_format IS NOT NULL) AS transform FROM g)
    SELECT message_id, query, asked_format, delivery, elaboration, new_knowledge, has_answer, scope, subject,
      CASE WHEN art THEN CASE WHEN asked_format = 'svg' THEN 'VISUALIZE' ELSE 'CREATE' END WHEN dia THEN 'VISUALIZE' WHEN download THEN 'DOWNLOAD' WHEN asked_format = 'svg' THEN 'VISUALIZE'
        WHEN asked_format IS NOT NULL AND creates AND {S.has('low', fixed.SHARE_VERB, '')} THEN 'CREATE_AND_DOWNLOAD' WHEN asked_format IS NOT NULL THEN 'CREATE' WHEN transform THEN 'SUMMARY' ELSE 'ANSWER' END AS intent,
      CASE WHEN dia THEN 'svg' ELSE asked_format END AS requested_format, dia OR coalesce(asked_format = 'svg', false) AS diagram,
      CASE WHEN art OR dia OR transform OR download THEN 'CURRENT_ANSWER' ELSE 'NEW_TOPIC' END AS context_type,
      CASE WHEN art OR dia THEN 'REPRESENT' WHEN download THEN 'DOWNLOAD' WHEN transform THEN 'REPRESENT' ELSE 'NONE' END AS relation,
      CAST(CASE WHEN art OR dia THEN 1.0 WHEN transform OR download THEN 0.65 ELSE 0.4 END AS DOUBLE) AS confidence,
      NOT (art OR dia) AND (both_ OR NOT (transform OR download)) AS new_information,
      CASE WHEN NOT (art OR dia) THEN subject END AS topic, CASE WHEN NOT (art OR dia) THEN scope END AS target_document FROM h)"""


def intent_rows(spark, folder):
    history = C.with_history(D.messages(spark, folder)).filter("role = 'user'").withColumnRenamed("content", "query")
    answered = F.exists("history", lambda m: (m["role"] == "assistant") & m["answer_id"].isNotNull())
    # Joins come before the rules: the rules are then one projection.
    history = C.with_past_scope(history, D.docs(spark, folder))
    turns = history.drop("topic").withColumns(
        {
            "has_answer": answered, "has_artifact": F.col("conv_id") % 2 == 0,
            "scope": F.when(F.col("query").contains("en src"), "en src"), "subject": F.lit(None).cast("string"),
        }
    )
    return R.with_rule_intent(R.with_turn_flags(turns))


@query(
    "rule_intents", "RTE-7 RTE-8",
    f"SELECT message_id, intent, requested_format, diagram, context_type, relation, confidence, new_information, target_document FROM {INTENT}",
)
def rule_intents(spark, folder):
    return intent_rows(spark, folder).select(
        "message_id", "intent", "requested_format", "diagram", "context_type", "relation", "confidence", "new_information", "target_document"
    )


MAKES = (
    "(CASE WHEN intent = 'VISUALIZE' THEN coalesce(requested_format, '') = 'svg' OR diagram "
    f"ELSE intent IN ('CREATE', 'CONVERT', 'CREATE_AND_DOWNLOAD') AND list_contains({S.strings(fixed.FILE_FORMATS)}, coalesce(requested_format, '')) END)"
)
FINAL = f"""(WITH r0 AS (SELECT * FROM {INTENT}),
    r1 AS (SELECT * REPLACE (CASE WHEN w THEN CASE WHEN asked_format = 'svg' THEN 'VISUALIZE' ELSE 'CREATE' END ELSE intent END AS intent,
       CASE WHEN w THEN asked_format ELSE requested_format END AS requested_format, CASE WHEN w THEN asked_format = 'svg' ELSE diagram END AS diagram)
       FROM (SELECT *, delivery AND NOT {MAKES} AND intent <> 'DOWNLOAD' AS w FROM r0)),
    r2 AS (SELECT * REPLACE (CASE WHEN w2 THEN CASE WHEN context_type = 'CURRENT_ANSWER' AND relation IN ('CONTINUE','TRANSFORM','MODIFY','REPRESENT') THEN 'SUMMARY' ELSE 'ANSWER' END ELSE intent END AS intent,
       CASE WHEN w2 THEN NULL ELSE requested_format END AS requested_format, CASE WHEN w2 THEN false ELSE diagram END AS diagram)
       FROM (SELECT *, NOT ((coalesce(requested_format, '') = 'svg' OR delivery) AND ({MAKES} OR intent = 'DOWNLOAD')) AS w2 FROM r1)),
    r3 AS (SELECT * REPLACE (CASE WHEN w3 THEN 'CREATE' ELSE intent END AS intent, CASE WHEN w3 THEN 'NEW_TOPIC' ELSE context_type END AS context_type,
       CASE WHEN w3 THEN 'NONE' ELSE relation END AS relation, CASE WHEN w3 THEN true ELSE new_information END AS new_information, CASE WHEN w3 THEN requested_format = 'svg' ELSE diagram END AS diagram)
       FROM (SELECT *, intent = 'DOWNLOAD' AND requested_format IS NOT NULL AND (new_information OR context_type = 'NEW_TOPIC' OR relation IN ('NEW_TOPIC', 'MULTI_TOPIC')) AS w3 FROM r2)),
    r4 AS (SELECT * REPLACE (coalesce(scope, target_document) AS target_document) FROM r3),
    r5 AS (SELECT * REPLACE (CASE WHEN w5 THEN 'ANSWER' ELSE intent END AS intent, CASE WHEN w5 THEN 'NEW_TOPIC' ELSE context_type END AS context_type, CASE WHEN w5 THEN 'NEW_TOPIC' ELSE relation END AS relation,
       CASE WHEN w5 THEN scope ELSE target_document END AS target_document, CASE WHEN w5 THEN true ELSE new_information END AS new_information)
       FROM (SELECT *, new_knowledge AND NOT {MAKES} AS w5 FROM r4)),
    r6 AS (SELECT * REPLACE (CASE WHEN w6 THEN 'SUMMARY' ELSE intent END AS intent, CASE WHEN w6 THEN NULL ELSE requested_format END AS requested_format, CASE WHEN w6 THEN false ELSE diagram END AS diagram,
       CASE WHEN w6 THEN 'CURRENT_ANSWER' ELSE context_type END AS context_type, CASE WHEN w6 THEN 'TRANSFORM' ELSE relation END AS relation, CASE WHEN w6 THEN false ELSE new_information END AS new_information)
       FROM (SELECT *, has_answer AND elaboration AS w6 FROM r5)),
    r7 AS (SELECT * REPLACE (CASE WHEN w7 THEN 'NEW_TOPIC' ELSE context_type END AS context_type, CASE WHEN w7 THEN 'NONE' ELSE relation END AS relation, CASE WHEN w7 THEN true ELSE new_information END AS new_information)
       FROM (SELECT *, NOT has_answer AND context_type = 'CURRENT_ANSWER' AND intent <> 'DOWNLOAD' AND NOT {MAKES} AS w7 FROM r6))
    SELECT * REPLACE (CASE WHEN w8 THEN 'CURRENT_ANSWER' ELSE context_type END AS context_type, CASE WHEN w8 THEN 'REPRESENT' ELSE relation END AS relation, CASE WHEN w8 THEN false ELSE new_information END AS new_information)
       FROM (SELECT *, has_answer AND context_type = 'NEW_TOPIC' AND {MAKES} AND {S.has('query', fixed.DEICTIC_CONVERSION)} AS w8 FROM r7))"""


@query(
    "routed_turns", "RTE-10 RTE-11 RTE-12",
    f"SELECT message_id, intent, requested_format, diagram, context_type, relation, new_information, target_document FROM {FINAL}",
)
def routed_turns(spark, folder):
    return R.with_overrides(intent_rows(spark, folder)).select(
        "message_id", "intent", "requested_format", "diagram", "context_type", "relation", "new_information", "target_document"
    )


@query(
    "carried_scope", "WIN-3",
    f"""WITH t AS (SELECT f.*, m.conv_id, m.turn FROM {FINAL} f JOIN {M} m ON m.message_id = f.message_id),
        past AS (SELECT t.message_id, arg_max(h.source_doc, h.turn) FILTER (WHERE h.source_doc IS NOT NULL) AS doc, arg_max(h.topic, h.turn) FILTER (WHERE h.topic IS NOT NULL AND h.answer_id IS NOT NULL) AS topic
            FROM t JOIN {M} h ON h.conv_id = t.conv_id AND h.turn < t.turn AND h.turn >= t.turn - 10 AND h.role = 'assistant' GROUP BY t.message_id)
        SELECT t.message_id, coalesce(t.target_document, CASE WHEN NOT (context_type = 'NEW_TOPIC' OR relation IN ('NEW_TOPIC', 'NONE') OR new_information) THEN lower(regexp_replace(d.doc_name, '\\.[^/.]+$', '')) END) AS target_document,
          coalesce(t.topic, CASE WHEN context_type = 'CURRENT_ANSWER' OR relation IN ('CONTINUE','TRANSFORM','MODIFY','REPRESENT') OR {S.has('query', fixed.FOLLOW_UP)} THEN past.topic END) AS topic
        FROM t LEFT JOIN past ON past.message_id = t.message_id LEFT JOIN {S.DOCS} d ON d.doc_id = past.doc""",
)
def carried_scope(spark, folder):
    turns = R.with_overrides(intent_rows(spark, folder))
    return C.with_carried_scope(turns).select("message_id", "target_document", "topic")


def context_turns(spark, folder):
    turns = R.with_overrides(intent_rows(spark, folder)).withColumn(
        "wanted_answer_id", F.when(F.col("turn") % 6 == 4, F.concat(F.lit("a"), F.col("conv_id"), F.lit("_1")))
    )
    return C.with_best_context(turns)


CONTEXT = f"""(WITH t AS (SELECT f.message_id, f.query, f.relation, f.new_information, f.intent, m.conv_id, m.turn, CASE WHEN m.turn % 6 = 4 THEN concat('a', m.conv_id, '_1') END AS wanted FROM {FINAL} f JOIN {M} m ON m.message_id = f.message_id),
    hist AS (SELECT t.message_id, h.message_id AS h_id, h.turn, h.content, h.answer_id, {USABLE.replace('role', 'h.role').replace('content', 'h.content').replace('answer_id', 'h.answer_id')} AS usable, h.role,
        list_distinct({S.tokens('t.query')}) AS qa, list_distinct({S.tokens('h.content')}) AS hb FROM t JOIN {M} h ON h.conv_id = t.conv_id AND h.turn < t.turn AND h.turn >= t.turn - 10),
    blocked AS (SELECT message_id, {S.has('arg_max(content, turn)', fixed.NO_EVIDENCE)} AS blocked FROM hist WHERE role = 'assistant' AND content <> '' GROUP BY message_id),
    pool AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY message_id) AS n FROM hist WHERE usable),
    scored AS (SELECT *, CASE WHEN len(qa) > 0 AND len(hb) > 0 THEN len(list_intersect(qa, hb)) / sqrt(len(qa)::DOUBLE * len(hb)) ELSE 0.0 END * 0.8 + i / n * 0.2 AS score FROM pool),
    best AS (SELECT message_id, max(score) AS score, arg_max(answer_id, (score, -i)) AS best, arg_max(answer_id, i) AS latest FROM scored GROUP BY message_id),
    exact AS (SELECT t.message_id, min(p.answer_id) AS exact FROM t JOIN pool p ON p.message_id = t.message_id AND (p.h_id = t.wanted OR p.answer_id = t.wanted) GROUP BY t.message_id)
    SELECT t.message_id, t.intent, round(b.score, 6) AS context_score,
      CASE WHEN coalesce(k.blocked, false) OR b.message_id IS NULL THEN NULL WHEN e.exact IS NOT NULL THEN e.exact WHEN t.new_information THEN NULL WHEN t.relation IS NULL THEN b.latest
        WHEN t.relation IN ('CONTINUE','TRANSFORM','MODIFY','REPRESENT','DOWNLOAD') THEN CASE WHEN b.score >= 0.3 THEN b.best ELSE b.latest END WHEN b.score >= 0.35 THEN b.best END AS context_answer
    FROM t LEFT JOIN blocked k ON k.message_id = t.message_id LEFT JOIN best b ON b.message_id = t.message_id LEFT JOIN exact e ON e.message_id = t.message_id)"""


@query("best_context", "RET-22 TXT-6", f"SELECT message_id, context_score, context_answer FROM {CONTEXT}")
def best_context(spark, folder):
    return context_turns(spark, folder).select("message_id", "context_score", F.col("context.answer_id").alias("context_answer"))


@query(
    "retrieval_modes", "RET-21",
    f"""SELECT c.message_id, CASE WHEN intent = 'DOWNLOAD' THEN 'DOWNLOAD' WHEN context_answer IS NOT NULL THEN 'CONTEXT_REF' WHEN (local OR (pronoun AND NOT verb)) AND l.turn > 6 THEN 'ANAPHORA_BYPASS' ELSE 'NEW_RAG' END AS mode
        FROM {CONTEXT} c JOIN {LOCAL} l ON l.message_id = c.message_id""",
)
def retrieval_modes(spark, folder):
    from lectern.operators.retrieval import retrieval_mode

    document = F.when(F.col("turn") > 6, F.repeat(F.lit("open document "), F.lit(9)))
    bypass = R.bypasses_retrieval(R.local_context(F.col("query"))["is_local"], F.lit(None).cast("string"), document)
    return context_turns(spark, folder).select(
        "message_id", retrieval_mode(F.col("intent"), F.col("context").isNotNull(), F.coalesce(bypass, F.lit(False))).alias("mode")
    )


@query(
    "route_evaluation", "RTE-15",
    f"""SELECT count(*) AS turns, CAST(count_if(hit) AS BIGINT) AS passed, round(avg(CAST(hit AS DOUBLE)), 6) AS pass_rate FROM (
          SELECT coalesce(requested_format, 'none') = {S.strings([e for _, e in D.UTTERANCES])}[((m.conv_id * 5 + m.turn) % {len(D.UTTERANCES)}) + 1] AS hit FROM {FINAL} f JOIN {M} m ON m.message_id = f.message_id)""",
)
def route_evaluation(spark, folder):
    expected = F.get(
        F.array(*[F.lit(e) for _, e in D.UTTERANCES]), ((F.col("conv_id") * 5 + F.col("turn")) % len(D.UTTERANCES)).cast("int")
    )
    routed = R.with_overrides(intent_rows(spark, folder)).select(expected.alias("expected"), F.col("requested_format").alias("actual"))
    return R.route_evaluation(routed)


RESOLVER_JSON = """(SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{"intent":"ANSWER"}' WHEN event_id % 11 = 0 THEN 'not json' ELSE
    concat('{"contextRelation":"', ['none','REPRESENT','Continue','LATER'][(event_id % 4) + 1], '","contextType":"NONE","resolvedAnswerId":null,"resolvedArtifactId":null,"intent":"', lower(event_type),
      '","requestedFormat":"', ['PDF','svg','exe'][(event_id % 3) + 1], '","topic":"t","confidence":', CASE WHEN event_id % 5 = 0 THEN '1.5' ELSE '0.5' END, ',"newInformationRequired":false', CASE WHEN event_id % 7 = 0 THEN ',"extra":1' ELSE '' END, '}') END AS doc
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'ANSWER' WHEN 'click' THEN 'summary' WHEN 'error' THEN 'CREATE' WHEN 'signup' THEN 'VISUALIZE' ELSE event_type END AS event_type FROM events))"""


@query(
    "resolver_checks", "RTE-9 RTE-10",
    f"""SELECT event_id, CASE WHEN broken THEN 'not a JSON object' WHEN event_id % 9 = 0 THEN 'missing keys' WHEN event_id % 7 = 0 THEN 'unknown keys'
          WHEN upper(json_extract_string(doc, '$.contextRelation')) NOT IN ('NONE', 'REPRESENT', 'CONTINUE') THEN 'contextRelation'
          WHEN upper(json_extract_string(doc, '$.intent')) NOT IN ({', '.join(S.lit(i) for i in fixed.INTENTS)}) THEN 'intent'
          WHEN upper(json_extract_string(doc, '$.requestedFormat')) NOT IN ({', '.join(S.lit(i) for i in fixed.RESOLVER_FORMATS)}) THEN 'requestedFormat'
          WHEN json_extract_string(doc, '$.confidence') = '1.5' THEN 'confidence' END AS reject_reason
        FROM (SELECT event_id, CASE WHEN json_valid(doc) THEN doc ELSE '{{"x":1}}' END AS doc, NOT json_valid(doc) AS broken FROM {RESOLVER_JSON})""",
)
def resolver_checks(spark, folder):
    key = F.col("event_id")
    names = F.create_map(*[F.lit(x) for x in ("view", "ANSWER", "click", "summary", "error", "CREATE", "signup", "VISUALIZE", "purchase", "purchase")])
    relation = F.get(F.array(*[F.lit(r) for r in ("none", "REPRESENT", "Continue", "LATER")]), (key % 4).cast("int"))
    fmt = F.get(F.array(*[F.lit(f) for f in ("PDF", "svg", "exe")]), (key % 3).cast("int"))
    doc = F.concat(
        F.lit('{"contextRelation":"'), relation, F.lit('","contextType":"NONE","resolvedAnswerId":null,"resolvedArtifactId":null,"intent":"'),
        F.lower(names[F.col("event_type")]), F.lit('","requestedFormat":"'), fmt, F.lit('","topic":"t","confidence":'),
        F.when(key % 5 == 0, "1.5").otherwise("0.5"), F.lit(',"newInformationRequired":false'),
        F.when(key % 7 == 0, ',"extra":1').otherwise(""), F.lit("}"),
    )
    rows = table(spark, folder, "events").select(
        "event_id", F.when(key % 9 == 0, '{"intent":"ANSWER"}').when(key % 11 == 0, "not json").otherwise(doc).alias("doc")
    )
    return R.checked_resolver_rows(rows, "doc").select("event_id", "reject_reason")


@query(
    "artifact_downloads", "RTE-14",
    """WITH a AS (SELECT o_custkey AS conv_id, ['pdf','csv','svg'][(o_orderkey % 3) + 1] AS format, o_orderkey AS artifact_id, o_orderkey AS created_at FROM orders),
       q AS (SELECT c_custkey AS conv_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ['pdf','csv','svg'][(c_custkey % 3) + 1] END AS requested_format FROM customer)
       SELECT q.conv_id, q.requested_format, max(a.artifact_id) AS artifact_id FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND (q.requested_format IS NULL OR a.format = q.requested_format) GROUP BY ALL""",
)
def artifact_downloads(spark, folder):
    formats = F.array(*[F.lit(f) for f in ("pdf", "csv", "svg")])
    artifacts = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("conv_id"), F.get(formats, (F.col("o_orderkey") % 3).cast("int")).alias("format"),
        F.col("o_orderkey").alias("artifact_id"), F.col("o_orderkey").alias("created_at"),
    )
    wanted = F.when(F.col("c_custkey") % 4 != 0, F.get(formats, (F.col("c_custkey") % 3).cast("int")))
    requests = table(spark, folder, "customer").select(F.col("c_custkey").alias("conv_id"), wanted.alias("requested_format"))
    return C.artifact_to_download(requests, artifacts).select("conv_id", "requested_format", "artifact_id")


# ---- updates ----------------------------------------------------------------
@query(
    "partial_updates", "UPD-2",
    """SELECT c.c_custkey, CASE WHEN c.c_custkey % 3 = 0 THEN 'renamed' ELSE c.c_name END AS c_name, CASE WHEN c.c_custkey % 5 = 0 THEN 'PINNED' ELSE c.c_mktsegment END AS c_mktsegment FROM customer c""",
)
def partial_updates(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = rows.filter("c_custkey % 3 = 0 OR c_custkey % 5 = 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "renamed").alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, "PINNED").alias("c_mktsegment")
    )
    return U.partial_update(rows, changes, "c_custkey", ["c_name", "c_mktsegment"])


@query("row_by_id", "UPD-4", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def row_by_id(spark, folder):
    return table(spark, folder, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus")


@query(
    "attached_artifacts", "UPD-5 TXT-26",
    """SELECT o_orderkey AS artifact_id, CASE WHEN o_orderkey IN (SELECT unnest([conv_id * 4, conv_id * 4 + 1]) FROM conversations) THEN concat('m', o_orderkey // 4) ELSE concat('old', o_orderkey) END AS source_message_id FROM orders""",
)
def attached_artifacts(spark, folder):
    artifacts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("artifact_id"), F.concat(F.lit("old"), F.col("o_orderkey")).alias("source_message_id")
    )
    # Id lists arrive as JSON text and become arrays at the edge.
    listed = F.to_json(F.array(F.col("conv_id") * 4, F.col("conv_id") * 4 + 1))
    links = table(spark, folder, "conversations").select(
        F.from_json(listed, "array<bigint>").alias("artifact_ids"), F.concat(F.lit("m"), F.col("conv_id")).alias("message_id")
    )
    return C.attached_artifacts(artifacts, links)


@query("deleted_charts", "UPD-6", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT item_id * 3 FROM benchmark)")
def deleted_charts(spark, folder):
    from lectern.operators.catalog import delete_cascade

    gone = table(spark, folder, "benchmark").select((F.col("item_id") * 3).alias("o_orderkey"))
    return delete_cascade(gone, "o_orderkey", table(spark, folder, "orders").select("o_orderkey"))[0]


@query(
    "retry_decisions", "UPD-9",
    """SELECT user_id, CAST(count_if(event_type = 'error' AND value > 50) AS BIGINT) AS attempts, CASE WHEN count_if(event_type = 'error' AND value > 50) = 0 THEN 'none'
       WHEN count_if(event_type = 'error' AND value > 50) < 3 THEN 'QUEUED' ELSE 'FAILED' END AS decision FROM events GROUP BY user_id""",
)
def retry_decisions(spark, folder):
    return U.retry_decision(table(spark, folder, "events"), "user_id", (F.col("event_type") == "error") & (F.col("value") > 50))


@query(
    "stalled_work", "UPD-10 TXT-27",
    """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS "at", count(*) AS events FROM events GROUP BY user_id)
       SELECT user_id, status, "at", events FROM l WHERE status NOT IN ('purchase', 'error') AND "at" < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 15 MINUTE""",
)
def stalled_work(spark, folder):
    as_of = F.timestamp_millis(F.lit(1706659200000))
    return U.stalled(table(spark, folder, "events"), "user_id", "ts", "event_type", "event_id", ["purchase", "error"], as_of).orderBy("at")


@query(
    "chart_versions", "WIN-17 UPD-3",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events WHERE event_type = 'click'",
)
def chart_versions(spark, folder):
    clicks = table(spark, folder, "events").filter("event_type = 'click'").select("event_id", "user_id", "ts")
    out = U.next_versions(clicks, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("day", "ts"))
    return out.select("event_id", "user_id", "version")


@query(
    "chunk_positions", "WIN-18 SET-4",
    f"""SELECT doc_id, content_hash, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS chunk_index FROM (
          SELECT doc_id, chunk_index, sha256(content) AS content_hash, row_number() OVER (PARTITION BY doc_id, content ORDER BY chunk_index) AS rn FROM {S.PARAGRAPHS}) WHERE rn = 1""",
)
def chunk_positions(spark, folder):
    from lectern.operators.split_windows import positions

    hashed = D.paragraphs(spark, folder).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_hash"))
    first = hashed.groupBy("doc_id", "content_hash").agg(F.min("chunk_index").alias("first_index"))
    placed = positions(first, ["doc_id"], [F.col("first_index")], F.floor(F.col("first_index") / 1024))
    return placed.select("doc_id", "content_hash", (F.col("position") - 1).alias("chunk_index"))
