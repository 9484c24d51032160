from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import routing as R
from lectern.operators import conversation as C
from lectern.operators import split_windows as S
from lectern.operators.evidence import presentation_order


def grouped(spark):
    # One key holds most rows.
    return spark.range(400).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"),
        F.col("id").alias("t"), (F.col("id") * 7 % 13).alias("v"),
    )


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


def test_split_windows_equal_plain_windows(spark):
    df, w = grouped(spark), Window.partitionBy("k").orderBy("t")
    bucket = F.floor(F.col("t") / 16)
    same(S.positions(df, ["k"], [F.col("t")], bucket).select("t", "position"), df.select("t", F.row_number().over(w).alias("position")))
    same(S.running_sum(df, ["k"], [F.col("t")], bucket, F.col("v"), "s").select("t", "s"), df.select("t", F.sum("v").over(w)))
    value = F.when(F.col("v") > 9, F.col("v"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same(
        S.last_before(df, ["k"], F.col("t"), bucket, {"p": value}).select("t", "p"),
        df.select("t", F.last(value, ignorenulls=True).over(before)),
    )
    placed = S.positions(df, ["k"], [F.col("t")], bucket)
    same(
        S.recent_rows(placed, ["k"], "position", 5, F.col("v"), "h", bucket_size=16).select("t", "h"),
        placed.select("t", F.collect_list("v").over(w.rowsBetween(-5, -1))),
    )


MESSAGE = "message_id string, conv_id bigint, turn bigint, role string, content string, answer_id string, source_doc_ids array<bigint>, topic string"


def resolve(spark, messages, query, relation="REPRESENT", wanted=None, new=False):
    rows = messages + [("q", 1, len(messages), "user", query, None, [], None)]
    turns = C.with_history(spark.createDataFrame(rows, MESSAGE)).filter("message_id = 'q'").withColumnRenamed("content", "query")
    turns = turns.withColumns(
        {"relation": F.lit(relation), "new_information": F.lit(new), "wanted_answer_id": F.lit(wanted).cast("string"), "topic": F.lit(None).cast("string")}
    )
    found = C.with_best_context(turns).first()["context"]
    return found and found["message_id"]


HISTORY = [
    ("a", 1, 0, "assistant", "Core Features: User Login and AI Search", "answer-a", [1], "core"),
    ("b", 1, 1, "assistant", "Security controls and access policies", "answer-b", [2], None),
]


def test_prior_answer_choice(spark):
    assert resolve(spark, HISTORY, "prepare security", wanted="b") == "b"
    assert resolve(spark, HISTORY, "core features login search", wanted="answer-a") == "a"
    assert resolve(spark, HISTORY, "core features user login and ai search") == "a"
    assert resolve(spark, HISTORY, "zzz") == "b"
    assert resolve(spark, HISTORY, "zzz", relation="NEW_TOPIC") is None
    assert resolve(spark, HISTORY, "security", new=True) is None
    refused = HISTORY + [("c", 1, 2, "assistant", "I cannot answer this", None, [], None)]
    assert resolve(spark, refused, "prepare security") is None


def test_named_utterances(spark):
    cases = [
        ("Put the numbers into a spreadsheet.", "xlsx"), ("Convert that to Excel.", "xlsx"), ("Now make it a PDF.", "pdf"),
        ("Now show it as a diagram.", "svg"), ("Map this out.", None), ("Prepare this for my manager.", None),
        ("Create a professional PowerPoint presentation based on the information.", "pptx"),
        ("Show the system architecture.", "svg"), ("Create a workflow.", "svg"), ("Convert this into DOCX.", "docx"),
    ]
    df = spark.createDataFrame(cases, "query string, expected string")
    for row in R.with_turn_flags(df).collect():
        assert row["asked_format"] == row["expected"], row["query"]


def test_local_reference_reasons(spark):
    df = spark.createDataFrame([("Explain the hotel data",), ("explain it",), ("Summarize this",), ("hello",)], "q string")
    got = [r[0]["is_local"] for r in df.select(R.local_context(F.col("q"))).collect()]
    assert got == [False, True, True, False]


def test_resolver_rows(spark):
    good = (
        '{"contextRelation":"represent","contextType":"CURRENT_ANSWER","resolvedAnswerId":"a","resolvedArtifactId":null,"intent":"CREATE",'
        '"requestedFormat":"PDF","topic":"t","confidence":0.95,"newInformationRequired":false,"theme":"executive","outputs":{"text_answer":true}}'
    )
    df = spark.createDataFrame([(good,), ('{"intent":"ANSWER"}',), (good.replace("0.95", "7"),)], "doc string")
    rows = R.checked_resolver_rows(df, "doc").collect()
    assert [r["reject_reason"] for r in rows] == [None, "missing keys", "confidence"]
    assert (rows[0]["relation"], rows[0]["requested_format"]) == ("REPRESENT", "pdf")


def test_prompt_rows(spark):
    turns = C.with_history(spark.createDataFrame(HISTORY + [("q", 1, 2, "user", "and now?", None, [], None)], MESSAGE)).filter("message_id = 'q'")
    turns = turns.select(F.lit(1).alias("query_id"), F.col("content").alias("query"), "history", F.lit("so far").alias("summary"), F.lit(None).cast("string").alias("charts_json"))
    proof = spark.createDataFrame([(1, 2, "b.txt", "second"), (1, 1, "a.txt", "first")], "query_id int, place int, doc_name string, content string")
    prompt = C.grounded_prompts(turns, proof).first()["prompt"]
    assert prompt.index("[1] a.txt\nfirst") < prompt.index("[2] b.txt\nsecond") < prompt.index("assistant: Core") < prompt.index("so far")
    assert prompt.endswith("Question: and now?") and "Charts" not in prompt


def test_presentation_order(spark):
    rows = spark.createDataFrame([(1, "d2", 5, 1), (1, "d1", 9, 2), (1, "d2", 1, 3), (1, "d1", None, 4)], "query_id int, doc_id string, chunk_index int, rank int")
    assert [r["rank"] for r in presentation_order(rows).orderBy("place").collect()] == [3, 1, 2, 4]


def test_a_verb_glued_to_a_pointer_opens_a_topic(spark):
    turns = spark.createDataFrame(
        [(1, "it is in thatwhat we saw"), (2, "explain that to me"), (3, "it: explain thatwhat"), (4, "explain the rest of it")], "id int, q string"
    )
    found = {r["id"]: (r["c"]["is_local"], r["c"]["reason"].split()[0]) for r in turns.select("id", R.local_context(F.col("q")).alias("c")).collect()}
    assert found == {1: (False, "Explicit"), 2: (True, "Deictic"), 3: (True, "Deictic"), 4: (False, "Explicit")}


def test_turns_without_a_document_are_spread_over_tasks(spark):
    from lectern.operators import conversation

    schema = "message_id string, history array<struct<role:string,source_doc_ids:array<bigint>,answer_id:string,topic:string>>"
    rows = [(f"m{i}", []) for i in range(400)] + [("x", [("assistant", [7, 8], "a", "t")]), ("y", [("assistant", [9], "a", None)]), (None, [])]
    turns = spark.createDataFrame(rows, schema)
    documents = spark.createDataFrame([(7, "Plan.txt")], "doc_id bigint, doc_name string")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("-1", "false")):
            spark.conf.set(name, value)
        out = conversation.with_past_scope(turns, documents)
        got = out.select("message_id", "past_document", "past_topic", F.spark_partition_id().alias("task")).collect()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert len(got) == 403 and {(r[0], r[1], r[2]) for r in got if r[1] or r[2]} == {("x", "plan", "t")}
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 250
