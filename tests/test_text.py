from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import pages as P
from lectern.operators.chunking import implicit_headings


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_vertical_lines_and_footer_leave_the_export(spark):
    text = "# Acme Report\n\n## Core\n- Role-based access control\n\n" + "\n".join("BestAPIs—Costs") + "\n\nAcme Page 1 of 1\n\n## References\n- Source: Studies"
    out = one(spark, text, lambda c: T.export_text(c, "Acme"))
    assert "Role-based access control" in out
    assert "B\ne\ns\nt" not in out
    assert "Acme Page 1 of 1" not in out


def test_report_polish(spark):
    text = (
        "# Explanation of Quarterly Summary Report\n\n# 2. Discount Intensity Analysis ## Discount Intensity = Discount / Total\n\n"
        "Business Insight OTA channels cost more.\n\n# Strategic Recommendations ## Recommendation 4 Implement controls. Expected Outcome: Better data.\n\n"
        "# Conclusion Leakage falls through data - driven decisions.\n\n# Strategic Recommendations ## Recommendation 4 Implement controls. Expected Outcome: Better data.\n\n"
        "# Conclusion Leakage falls through data - driven decisions."
    )
    out = one(spark, text, T.export_text)
    assert out.startswith("# Quarterly Summary Report")
    for piece in ("## Discount Intensity Analysis", "### Business Insight:", "## Recommendation 4", "data-driven decisions"):
        assert piece in out
    assert out.count("## Conclusion") == 1


def test_flattened_list_heading(spark):
    text = "Access Controls-User Login-User Roles-Role-Based Access Control (RBAC)-Document-Level Permissions"
    out = one(spark, text, T.list_from_heading)
    assert out["heading"] == "Access Controls"
    assert out["items"] == ["User Login", "User Roles", "Role-Based Access Control (RBAC)", "Document-Level Permissions"]
    assert one(spark, "short - one", T.list_from_heading) is None


def test_numbered_line_to_list(spark):
    assert one(spark, "Core Features 1. Access 2. Search", T.numbered_list_from_line) == "### Core Features\n\n1. Access\n2. Search"
    assert one(spark, "1. Access here 2. Search here", T.numbered_list_from_line) is None  # already a list
    assert one(spark, "Only 1. One", T.numbered_list_from_line) is None


def test_citations_and_back_reference(spark):
    text = "Fact (Source: a.pdf) (Source: a.pdf)(Source: Chunk 3) and Chunk 12 end"
    assert one(spark, text, T.clean_citations) == "Fact (Source: a.pdf) and end"


def test_title_that_repeats_the_question(spark):
    rows = spark.createDataFrame(
        [("# Explain hotel data\n\nBody", "explain hotel data"), ("# Rooms\n\nBody", "explain hotel data"), ("Hotel data\nBody", "hotel data")],
        "a string, q string",
    )
    got = [r[0] for r in rows.select(T.fix_title(F.col("a"), F.col("q"), F.lit("ANSWER"), F.lit("hotel data"))).collect()]
    assert got == ["# Explanation of Hotel Data\n\nBody", "# Rooms\n\nBody", "<h3>Overview of Hotel Data</h3>\n\nBody"]


def test_word_limit_has_slack(spark):
    text = " ".join(f"w{i}" for i in range(11))
    assert one(spark, text, lambda c: T.limit_words(c, F.lit(10))) == text
    assert one(spark, text, lambda c: T.limit_words(c, F.lit(5))) == "w0 w1 w2 w3 w4."


def test_claims(spark):
    text = "<p>Hotel bookings include reservation dates and room types. (Source: hotel.csv)</p> Here is the summary of all things you wanted. Short."
    assert one(spark, text, T.claim_sentences) == ["Hotel bookings include reservation dates and room types."]


def test_misread_punctuation(spark):
    from lectern.functions import fixed

    broken = "a" + fixed.MOJIBAKE[0][1] + "b" + fixed.MOJIBAKE[2][0] + "c"
    assert one(spark, broken, T.print_text) == "a—b’c"


def test_source_blocks(spark):
    text = "Intro\n\n## Source: file.pdf\nText\n\n## Sources\n- a.pdf\n\nEnd"
    out = one(spark, text, T.drop_source_blocks)
    assert "file.pdf" not in out and "a.pdf" not in out and out.startswith("Intro") and out.endswith("End")


def test_accented_letters_are_no_word_characters(spark):
    assert one(spark, "éin about", lambda c: T.rx(c, r"\bin\b", "#")) == "é# about"


def test_page_furniture(spark):
    text = "<!-- PAGE 1 -->\nCompany Report\nalpha text\n1\n<!-- PAGE 2 -->\nCompany  report\nbeta text\nPage 2 of 2"
    out = one(spark, text, P.structured_clean_pages)
    assert out == "<!-- PAGE 1 -->\nalpha text\n<!-- PAGE 2 -->\nbeta text"
    single = "Company Report\nalpha\nbeta\nCompany Report"
    assert one(spark, single, P.structured_clean_pages) == single


def test_scan_pages(spark):
    docs = spark.createDataFrame([(1, "--- Page 1 ---\nfirst page\n--- Page 2 ---\nsecond page")], "doc_id int, text string")
    rows = [(r["page"], "page" in r["page_text"]) for r in P.pages_of(docs).orderBy("page").collect()]
    assert rows == [(1, True), (2, True)]


def test_implicit_headings(spark):
    out = one(spark, "Intro label\n\n- a\n\n1. Next Part\n\n- b\n\nA sentence.\n\n- c", implicit_headings)
    assert out == "# Intro label\n\n- a\n\n## 1. Next Part\n\n- b\n\nA sentence.\n\n- c"


def test_fixed_point_rounds_the_exact_value(spark):
    values = [k / 2000 for k in range(-40, 2400, 7)] + [0.4795, 0.2945, 0.3005, 0.0625, 0.1875, -0.0004, 0.0, 0.9995, 12.3455, 1 / 3]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", T.fixed_point(F.col("x"), 3).alias("s")).collect()
    assert [r["s"] for r in rows] == ["%.3f" % r["x"] for r in rows]


def test_scopes_move_no_query_phrases_where_names_are_few(spark):
    from lectern.operators import lexical as L

    docs = spark.createDataFrame([(2, "big red fox 12.txt"), (1, "red fox.txt")], "doc_id bigint, doc_name string")
    asked = spark.createDataFrame([(1, "the big red fox ran"), (2, "a red fox"), (3, "nothing")], "query_id bigint, query string")
    scope = L.name_scope(asked, docs)
    plan = scope._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["query_id"]: r["scope"] for r in scope.collect()} == {1: "big red fox", 2: "red fox"}


def test_word_boundaries_are_one_test_where_the_pattern_has_the_word():
    import random
    import re

    from lectern.functions import fixed
    from lectern.functions.patterns import ASCII_BOUNDARY, jvm

    noise = (*fixed.TOPIC_NOISE, *fixed.RETRIEVAL_NOISE)
    assert not any(ASCII_BOUNDARY in jvm(p) for p in noise)
    rng = random.Random(7)
    for p in (*noise, fixed.DEICTIC_CONVERSION, r"\bfoo?\b", r"\b(?:a|b)?c\b", r"x|\by\b|z\d\b", r"(?:ab|c[de])\b", r"\(a\)\b", r"(the|\ban)\b"):
        words = re.findall(r"\w+", p) + list(" _.é()") + ["foo", "z1"]
        plain, fast = re.compile(p.replace(r"\b", ASCII_BOUNDARY), re.I), re.compile(jvm(p), re.I)
        for _ in range(300):
            text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(12))
            assert [m.span() for m in plain.finditer(text)] == [m.span() for m in fast.finditer(text)]


def test_a_cleaned_text_is_made_once_where_blanks_become_null(spark):
    df = spark.createDataFrame([(" a  b ",), (" \t",), (None,)], "x string")
    made = df.select(T.blank_to_null(T.collapse(F.col("x"))).alias("y"))
    assert [r["y"] for r in made.collect()] == ["a b", None, None]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_report_repairs_are_tried_only_where_their_words_stand(spark):
    import random

    from lectern.functions import fixed

    # One pattern after the other on every text, without a look at its words first.
    def plain(c):
        out = F.coalesce(c, F.lit(""))
        for pattern, replacement, flags in [*(f[:3] for f in T.REPORT_FIXES), *T.GLUED_HEADINGS, *T.HEADING_FIXES]:
            if "(?<=[^" in pattern:
                pattern, replacement = r"([^\n])\s+(#{1,3}\s+(?=[A-Z0-9]))", "$1\n\n$2"
            out = T.rx(out, pattern, replacement, flags)
        out = T.trim_all(T.rx(out, r"\n{3,}", "\n\n"))
        return T.trim_all(T.rx(T.distinct_sections(T.single_title(out)), r"\n{3,}", "\n\n"))

    bits = [
        "# Explanation of Costs", "R ecommendation 4 use", "recommendation 2 do", "data - driven", "a -b", "\tBUSINESS insight Good", "Business Insight: x",
        "expected outcome: y", "Conclusion it ends", "## 3. Third", "# Sources - one", "## Discount Intensity = x", "### 2. B", "#### C", " ## D", "word", "é",
    ]
    rng = random.Random(3)
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "\n", "\n\n", "\n\n\n", " \n "]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string")
    rows = df.select(T.polish_report(F.col("x")).alias("got"), plain(F.col("x")).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and len({r["got"] for r in rows}) > 300
    assert one(spark, "a" + fixed.MOJIBAKE[5][0] + fixed.CUT_QUOTE[0], lambda c: T.repair_punctuation(c, 2)) == "a…”"
