"""Diagram tables: nodes, edges, labels and levels, for all diagrams at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.functions.patterns import jvm
from lectern.operators.ranking import top_per_group
from lectern.session import cut_lineage


def _id(col: Column) -> Column:
    return F.regexp_replace(T.clean_label(col, 64), F.lit("[^A-Za-z0-9_-]"), F.lit("_"))


def enum_or(col: Column, members: list[str], default: str) -> Column:
    return F.when(col.isin(members), col).otherwise(F.lit(default))


def checked_settings(diagrams: DataFrame) -> DataFrame:
    """Template, theme, palette and title with safe defaults."""
    title = T.clean_label(F.col("title"), 120)
    return diagrams.withColumns(
        {
            "template": enum_or(F.col("template"), fixed.DIAGRAM_TEMPLATES, "process_flow"),
            "theme": enum_or(F.col("theme"), fixed.DIAGRAM_THEMES, "professional"),
            "palette": enum_or(F.col("palette"), fixed.DIAGRAM_PALETTES, "blue"),
            "title": F.coalesce(T.blank_to_null(title), F.lit("Generated Diagram")),
        }
    )


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """The first fifty nodes of a diagram, cleaned; of equal ids the first stays."""
    first = top_per_group(nodes, ["artifact_id"], [F.col("pos")], fixed.MAX_NODES, rank="_n")
    named = first.withColumn(
        "id", F.coalesce(T.blank_to_null(_id(F.col("id"))), F.concat(F.lit("node_"), F.col("_n")))
    )
    clean = named.withColumn("label", F.coalesce(T.blank_to_null(T.clean_label(F.col("label"), 120)), F.col("id")))
    return clean.groupBy("artifact_id", "id").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"))


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first hundred edges of a diagram whose two different ends are known nodes."""
    first = top_per_group(edges, ["artifact_id"], [F.col("pos")], fixed.MAX_EDGES, rank="_n").drop("_n")
    clean = first.withColumns({"source": _id(F.col("source")), "target": _id(F.col("target"))})
    clean = clean.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    ends = nodes.select("artifact_id", "id")
    for end in ("source", "target"):
        clean = clean.join(ends.withColumnRenamed("id", end), ["artifact_id", end], "left_semi")
    return clean


def step_edges(nodes: DataFrame) -> DataFrame:
    """Neighbouring nodes become edges. A diagram has at most fifty nodes."""
    from pyspark.sql.window import Window

    following = F.lead("id").over(Window.partitionBy("artifact_id").orderBy("pos"))
    return nodes.select("artifact_id", F.col("id").alias("source"), following.alias("target")).filter("target is not null")


def first_labels(labels: DataFrame, count: int = 6) -> DataFrame:
    """First few distinct labels (artifact_id, label, place)."""
    once = labels.groupBy("artifact_id", "label").agg(F.min("pos").alias("pos"))
    return top_per_group(once, ["artifact_id"], [F.col("pos")], count, rank="place")


def label_candidates(answers: DataFrame) -> DataFrame:
    """Labels of an answer: headings of level three and below, else its sentences (artifact_id, pos, label)."""
    text = F.coalesce("answer", F.lit(""))
    heads = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?m)^\s*(#{3,6}\s+.+?)\s*$"), F.lit(1)),
            lambda h: T.trim_all(T.rx(F.replace(T.rx(h, r"\A#{3,6}\s+", ""), F.lit("**"), F.lit("")), r"\A\d+\.\s*", "")),
        ),
        lambda h: F.length(h) >= 3,
    )
    plain = T.rx(text, r"</(?:p|div|li|h[1-6]|br)\s*>", "\n", "i")
    plain = T.rx(T.rx(plain, r"<br\s*/?>", "\n", "i"), r"<[^>]+>", " ")
    plain = T.rx(T.rx(plain, fixed.SOURCE_NOTE_ROUND, "", "i"), fixed.SOURCE_NOTE_SQUARE, "", "i")
    plain = T.decode_entities(plain)
    lines = F.filter(
        F.transform(
            F.split(plain, jvm(r"\n+|(?<=[.!?])\s+")),
            lambda s: T.collapse(F.replace(T.rx(s, r"\A\s*(?:#{1,6}\s*|[-*•]\s*|\d+[.)]\s*)+", ""), F.lit("**"), F.lit(""))),
        ),
        lambda s: (F.length(s) >= 8) & ~T.matches(s, r"\Asource\s*:"),
    )
    chosen = T.bind(heads, lambda h: F.when(F.size(h) > 0, h).otherwise(lines))
    return answers.select("artifact_id", F.posexplode(chosen).alias("pos", "label")).withColumn("label", F.left("label", F.lit(90)))


def diagram_title(answer: Column, fallback: Column) -> Column:
    """HTML heading, else a level-two, else a level-one heading, else the fallback."""
    html = F.regexp_extract(answer, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1)
    two = F.regexp_extract(answer, r"(?m)^\s*##\s+(.+?)\s*$", 1)
    one = F.regexp_extract(answer, r"(?m)^\s*#\s+(.+?)\s*$", 1)
    raw = F.coalesce(*[T.blank_to_null(c) for c in (html, two, one)], fallback, F.lit("Information Flow"))
    clean = T.collapse(F.replace(F.replace(T.rx(raw, r"<[^>]+>", " "), F.lit("**"), F.lit("")), F.lit("&amp;"), F.lit("&")))
    return F.coalesce(T.blank_to_null(F.left(clean, F.lit(80))), F.lit("Information Flow"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first depth of every node (artifact_id, id, level).

    Roots have no incoming edge; a diagram without a root starts at its first
    node; nodes that are never reached come one level after the deepest. One
    round of joins serves all diagrams; a round is cut by a reliable checkpoint.
    """
    keys = ["artifact_id", "id"]
    nodes = nodes.select("artifact_id", "id", "pos")
    edges = cut_lineage(edges.select("artifact_id", F.col("source").alias("id"), "target").distinct())
    roots = nodes.join(edges.select("artifact_id", F.col("target").alias("id")), keys, "left_anti")
    rootless = nodes.join(roots.select("artifact_id").distinct(), "artifact_id", "left_anti")
    starts = rootless.groupBy("artifact_id").agg(F.min_by("id", "pos").alias("id"))
    seen = cut_lineage(roots.select(*keys).unionByName(starts).distinct().withColumn("level", F.lit(0)))
    frontier, depth = seen, 0
    while True:
        depth += 1
        reached = (
            frontier.select(*keys).join(edges, keys).select("artifact_id", F.col("target").alias("id")).distinct()
            .join(seen.select(*keys), keys, "left_anti")
            .withColumn("level", F.lit(depth))
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    deepest = seen.groupBy("artifact_id").agg((F.max("level") + 1).alias("level"))
    left_over = nodes.select(*keys).join(seen.select(*keys), keys, "left_anti").join(deepest, "artifact_id")
    return seen.unionByName(left_over.select(*keys, "level"))
