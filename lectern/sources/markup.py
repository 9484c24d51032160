"""JSON, YAML and SVG text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as T


def _shown(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def _children(value) -> list[tuple[str, object]]:
    """Steps from a container to its members; a scalar has none."""
    if isinstance(value, dict):
        return [(f".{k}", v) for k, v in value.items()]
    if isinstance(value, list):
        return [(f"[{k}]", v) for k, v in enumerate(value)]
    return []


def path_lines(value) -> str:
    """``path: value`` lines of nested JSON, at any depth.

    Nodes are listed parents first; their texts are then put together from the
    last to the first, so no call nests.
    """
    nodes = [("", value, -1)]
    at = 0
    while at < len(nodes):
        path, node, _ = nodes[at]
        nodes += [(path + step if path else step.removeprefix("."), child, at) for step, child in _children(node)]
        at += 1
    parts: list[list[str]] = [[] for _ in nodes]
    for (path, node, parent), own in zip(reversed(nodes), reversed(parts)):
        text = "\n".join(reversed(own)) if isinstance(node, (dict, list)) else _shown(node)
        if parent >= 0:
            named = isinstance(nodes[parent][1], dict)
            parts[parent].append(f"{path}:{chr(10) if chr(10) in text else ' '}{text}" if named else text)
    return "\n".join(reversed(parts[0])) if isinstance(value, (dict, list)) else _shown(value)


@F.pandas_udf(StringType())
def _nested_lines(docs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(doc: str) -> str:
        try:
            return path_lines(json.loads(doc))
        except (TypeError, ValueError):
            return doc

    for batch in docs:
        yield batch.map(one, na_action="ignore")


def json_lines(df: DataFrame, column: str, out: str = "lines") -> DataFrame:
    """``path: value`` lines of a JSON column.

    Flat objects stay in the JVM. Only rows with nesting, of any depth, visit Python.
    """
    doc = F.col(column)
    flat = F.from_json(doc, "map<string,string>")
    joined = F.array_join(
        F.transform(F.map_entries(flat), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n"
    )
    is_flat = doc.rlike(r"(?s)\A\s*\{[^{}\[\]]*\}\s*\z") & ~doc.contains("\\") & flat.isNotNull()
    return df.withColumn(out, F.when(is_flat, joined)).withColumn(
        out, F.coalesce(F.col(out), _nested_lines(F.when(F.col(out).isNull(), doc)))
    )


def yaml_as_json(doc: str) -> str:
    """A YAML text as JSON; one that is no YAML as it is."""
    import yaml

    try:
        return json.dumps(yaml.safe_load(doc), default=str)
    except yaml.YAMLError:
        return doc


@F.pandas_udf(StringType())
def _yaml_as_json(docs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in docs:
        yield batch.map(yaml_as_json, na_action="ignore")


def yaml_lines(df: DataFrame, column: str, out: str = "lines") -> DataFrame:
    """As ``json_lines`` for YAML; needs the optional yaml package on the workers.

    A text that is no YAML stays as it is.
    """
    staged = df.withColumn("__json", _yaml_as_json(F.col(column)))
    return json_lines(staged, "__json", out).drop("__json")


def svg_labels(svg):
    """Text of ``<text>`` and ``<tspan>`` elements, one label per line."""
    body = T.rx(svg, r"(?s)<script.*?</script>", "", "i")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(text|tspan)[^>]*>(.*?)</(?:text|tspan)>"), F.lit(2))
    bare = F.transform(found, lambda x: T.trim_all(T.rx(x, r"<[^>]*>", "")))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")
