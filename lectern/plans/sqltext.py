"""Spelling of the same text steps in the SQL used to check results."""

from __future__ import annotations

from lectern.functions import fixed
from lectern.functions.patterns import sql_re2


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def rep(x: str, pattern: str, new: str = "", flags: str = "") -> str:
    return f"regexp_replace({x}, {sql_re2(pattern)}, {lit(new)}, 'g{flags}')"


def has(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {sql_re2(pattern)}" + (f", '{flags}')" if flags else ")")


def trim_all(x: str) -> str:
    return rep(x, r"^\s+|\s+$")


def collapse(x: str) -> str:
    return trim_all(rep(x, r"\s+", " "))


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def content_terms(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: NOT list_contains({strings(fixed.STOPWORDS)}, t))"


def scope_stem(t: str) -> str:
    return (
        f"CASE WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN concat(left({t}, length({t}) - 3), 'y') "
        f"WHEN ends_with({t}, 's') AND length({t}) > 3 THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def scope_terms(x: str) -> str:
    return f"list_transform({content_terms(x)}, lambda st: {scope_stem('st')})"


def searchable(x: str) -> str:
    out = rep(f"coalesce({x}, '')", fixed.DATA_LINK, " ", "i")
    out = rep(out, fixed.DATA_IMAGE, " ", "i")
    out = rep(out, fixed.BASE64_32, " ", "i")
    return collapse(out)


def strip_artifacts(x: str) -> str:
    out = rep(f"coalesce({x}, '')", fixed.DATA_LINK_LOOSE, "", "i")
    out = rep(out, fixed.DATA_ANY, "", "i")
    out = rep(out, fixed.BASE64_160, "", "i")
    out = f"replace({out}, '\\.', '.')"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    out = rep(out, fixed.SCRIPT_BLOCK, "", "i")
    out = rep(out, fixed.STYLE_BLOCK, "", "i")
    out = rep(out, fixed.LAYOUT_TAG, "", "i")
    return rep(out, r"\r\n?", "\n")


def tidy(x: str) -> str:
    return trim_all(rep(rep(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def decode_entities(x: str) -> str:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def rules(x: str, table, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {has(x, p, '')} THEN {lit(v)}" for v, p in table)
    return f"(CASE {arms} ELSE {default} END)"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


# Tables derived from the given ones, as in lectern.plans.derived.
DOCS = (
    "(SELECT doc_id, source AS org_id, concat(lang, ' ', source, ' ', doc_id, '.txt') AS doc_name, "
    "lang, text, n_chars FROM documents)"
)
PARAGRAPHS = (
    "(SELECT concat(doc_id, '_v1_chunk_', i - 1) AS chunk_id, doc_id, i - 1 AS chunk_index, parts[i] AS content "
    "FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM "
    "(SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"
)
CATALOG = (
    "(SELECT d.doc_id, d.source AS org_id, concat(d.lang, ' ', d.source, ' ', d.doc_id, '.txt') AS doc_name, "
    "d.n_chars AS size_bytes, CASE WHEN l.quality = 1 THEN 'READY' WHEN l.quality = 0 THEN 'FAILED' "
    "ELSE 'QUEUED' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
)


def uploads() -> str:
    endings = fixed.SUPPORTED_EXTENSIONS + ["exe", "bin", "PDF"]
    return (
        "(SELECT p_partkey AS file_id, concat('org', p_partkey % 3) AS org_id, "
        "CASE WHEN p_partkey % 53 = 0 THEN concat('/srv/x/', chr(1), '..') ELSE "
        "concat('/srv/in box/', p_name, CASE WHEN p_partkey % 11 = 0 THEN '..' ELSE '' END, chr(9), ' v', p_size, '  .', "
        f"{strings(endings)}[(p_partkey % {len(endings)}) + 1]) END AS raw_name, "
        "CAST(CASE WHEN p_partkey % 17 = 0 THEN 0 WHEN p_partkey % 13 = 0 THEN 52428801 + p_partkey * 1013 "
        "ELSE p_size * 1000 + p_partkey END AS BIGINT) AS size_bytes, "
        "sha256(concat(p_name, '|', p_size)) AS sha256, "
        "CASE WHEN p_partkey % 3 = 0 THEN 'application/x-upload' END AS declared_mime FROM part)"
    )


def safe_name(x: str) -> str:
    out = f"regexp_replace(string_split({x}, '/')[-1], '[\\x00-\\x1f\\x7f]', '', 'g')"
    return f"coalesce(nullif({collapse(f'replace({out}, $$..$$, $$$$)')}, ''), 'unnamed_file')"


def unit_label(x: str) -> str:
    arms = " ".join(f"WHEN list_contains({strings(m)}, {x}) THEN {lit(u)}" for u, m in fixed.UNIT_LABELS.items())
    return f"(CASE {arms} ELSE '{fixed.DEFAULT_UNIT}' END)"


def mime_type(x: str) -> str:
    return "(CASE " + x + " " + " ".join(f"WHEN {lit(e)} THEN {lit(m)}" for e, m in fixed.MIME_TYPES.items()) + " END)"


NAMED_UPLOADS = (
    f"(SELECT *, lower(string_split(name, '.')[-1]) AS extension FROM "
    f"(SELECT *, {safe_name('raw_name')} AS name FROM {uploads()}))"
)


def upload_errors() -> str:
    supported = ", ".join("." + e for e in fixed.SUPPORTED_EXTENSIONS)
    return (
        "list_filter(["
        f"CASE WHEN NOT list_contains({strings(fixed.SUPPORTED_EXTENSIONS)}, extension) "
        f"THEN concat('Unsupported file type: .', extension, '. Supported: {supported}') END, "
        "CASE WHEN size_bytes > 52428800 THEN printf('File too large: %.1f MB. Maximum: 50 MB', size_bytes / 1048576.0) END, "
        "CASE WHEN size_bytes = 0 THEN 'File is empty' END], lambda e: e IS NOT NULL)"
    )


def messages() -> str:
    from lectern.plans.derived import UTTERANCES

    openings = strings([u for u, _ in UTTERANCES])
    answered = "(role = 'assistant' AND (conv_id + turn) % 4 <> 3)"
    return (
        "(SELECT concat('m', conv_id, '_', turn) AS message_id, conv_id, turn, role, "
        f"CASE WHEN role = 'user' THEN concat({openings}[((conv_id * 5 + turn) % {len(UTTERANCES)}) + 1], ' ', text) "
        "WHEN role = 'assistant' AND (conv_id + turn) % 6 = 5 THEN concat('I cannot answer that. ', text) ELSE text END AS content, "
        f"CASE WHEN {answered} THEN concat('a', conv_id, '_', turn) END AS answer_id, "
        f"CASE WHEN {answered} AND (conv_id + turn) % 3 = 0 THEN conv_id * 7 + turn END AS source_doc, "
        f"CASE WHEN {answered} AND (conv_id + turn) % 5 < 2 THEN concat('topic ', conv_id % 10) END AS topic FROM conversations)"
    )
