"""The whole hybrid search with every arm at once: tenants, unfinished rows, scopes by id and by name, named documents
and sibling sections. A chunk is a given document; a book is all chunks of one language and shelf (the first letters of
the source); the language is the tenant."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import search as Q
from lectern.plans import sqltext as S
from lectern.plans.registry import query, table

AREAS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet"]


# ---- inputs -----------------------------------------------------------------
def _area(label):
    return F.concat(F.get(F.array(*[F.lit(a) for a in AREAS]), (label % len(AREAS)).cast("int")), F.lit(" area"))


def _shelved(spark, folder):
    return table(spark, folder, "documents").withColumn("shelf", F.substring("source", 1, 4))


def _books(spark, folder):
    """The document id of each language and shelf."""
    return _shelved(spark, folder).groupBy("lang", "shelf").agg(F.min("doc_id").alias("book"))


def _labels(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")


def book_chunks(spark, folder):
    """Chunks of books: finished where the label is good, under the heading of their vector's area."""
    quality = table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    rows = _shelved(spark, folder).join(_books(spark, folder), ["lang", "shelf"]).select(
        F.col("doc_id").alias("chunk_id"), F.col("book").alias("doc_id"), F.col("lang").alias("org_id"),
        F.concat("lang", F.lit(" "), "shelf", F.lit(".txt")).alias("doc_name"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"),
    )
    return (
        rows.join(quality, "chunk_id", "left").join(_labels(spark, folder), "chunk_id", "left")
        .withColumn("status", F.when(F.col("quality") == 1, "READY").otherwise("QUEUED"))
        .withColumn("parent_headings", F.when(F.col("label").isNotNull(), F.array(F.lit("Overview"), _area(F.col("label")))))
        .drop("quality", "label")
    )


def scoped_queries(spark, folder):
    """A benchmark passage's words, asked in turn inside a book by id, inside one by name and topic, naming a book, and plainly."""
    w = lambda n: F.coalesce(F.get("w", F.lit(n - 1)), F.lit(""))
    arm, name = F.col("query_id") % 4, F.concat("lang", F.lit(" "), "shelf")
    words = F.concat(w(5), F.lit(" or "), w(1), F.lit(" "), w(2))
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("w"))
    owner = _shelved(spark, folder).join(_books(spark, folder), ["lang", "shelf"]).select(F.col("doc_id").alias("query_id"), "lang", "shelf", "book")
    label = _labels(spark, folder).withColumnRenamed("chunk_id", "query_id")
    return asked.join(owner, "query_id").join(label, "query_id", "left").select(
        "query_id", F.col("lang").alias("org_id"),
        F.when(arm == 0, F.col("book")).alias("active_document"),
        F.when(arm == 1, name).alias("target_document"),
        F.when(arm == 1, _area(F.col("label"))).alias("topic"),
        F.when(arm == 1, F.concat(name, F.lit(" "), words))
        .when(arm == 2, F.concat(F.lit("Tell me about the "), name, F.lit(" file: "), words)).otherwise(words).alias("query"),
    )


# ---- the same in SQL --------------------------------------------------------
_AREA = f"concat(list_extract([{', '.join(repr(a) for a in AREAS)}], CAST(label % {len(AREAS)} AS INTEGER) + 1), ' area')"
_WORDS = "concat(coalesce(w[5], ''), ' or ', coalesce(w[1], ''), ' ', coalesce(w[2], ''))"
_OR = Q.OR_HITS.replace(
    f"(SELECT item_id AS query_id, {S.content_terms('text')} AS terms FROM benchmark)",
    f"(SELECT query_id, {S.content_terms('query')} AS terms FROM xq WHERE query_id NOT IN (SELECT query_id FROM scope))",
)
_IN_SCOPE = "len({terms}) > 0 AND len(list_filter({parents}, lambda h: list_has_all({heading}, {terms}))) > 0".format(
    terms=S.scope_terms("topic"), parents="parent_headings", heading=S.scope_terms("h")
)
INPUTS = f"""
  shelved AS (SELECT *, substr(source, 1, 4) AS shelf FROM documents),
  books AS (SELECT lang, shelf, min(doc_id) AS book FROM shelved GROUP BY lang, shelf),
  xc AS MATERIALIZED (SELECT d.doc_id AS chunk_id, b.book AS doc_id, d.lang AS org_id, concat(d.lang, ' ', d.shelf, '.txt') AS doc_name, d.text AS content,
        CASE WHEN label IS NOT NULL THEN ['Overview', {_AREA}] END AS parent_headings
      FROM shelved d JOIN books b ON b.lang = d.lang AND b.shelf = d.shelf JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
  xq AS MATERIALIZED (SELECT query_id, lang AS org_id, CASE WHEN query_id % 4 = 0 THEN book END AS active_document,
        CASE WHEN query_id % 4 = 1 THEN concat(lang, ' ', shelf) END AS target_document, CASE WHEN query_id % 4 = 1 THEN {_AREA} END AS topic,
        CASE query_id % 4 WHEN 1 THEN concat(lang, ' ', shelf, ' ', {_WORDS}) WHEN 2 THEN concat('Tell me about the ', lang, ' ', shelf, ' file: ', {_WORDS}) ELSE {_WORDS} END AS query
      FROM (SELECT item_id AS query_id, {S.tokens('text')} AS w FROM benchmark) JOIN (SELECT doc_id AS query_id, lang, shelf FROM shelved) USING (query_id)
      JOIN books USING (lang, shelf) LEFT JOIN (SELECT vec_id AS query_id, label FROM embeddings) USING (query_id)),
  scope AS MATERIALIZED (SELECT DISTINCT q.query_id, c.doc_id FROM xq q JOIN xc c ON c.org_id = q.org_id
      WHERE c.doc_id = q.active_document OR (q.active_document IS NULL AND contains(lower(c.doc_name), lower(q.target_document)))),
  allowed AS MATERIALIZED (SELECT q.query_id, c.chunk_id, c.doc_id FROM xq q JOIN xc c ON c.org_id = q.org_id LEFT JOIN scope s ON s.query_id = q.query_id
      WHERE s.query_id IS NULL OR s.doc_id = c.doc_id)"""
SCOPED_HYBRID = f"""WITH {INPUTS},
  bare AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM scope) AND target_document IS NOT NULL THEN {S.collapse("replace(query, target_document, ' ')")} ELSE query END AS query FROM xq
      WHERE len({S.content_terms('query')}) > 0),
  xalts AS MATERIALIZED (SELECT query_id, alt, list_distinct(terms) AS terms FROM (SELECT query_id, i AS alt, {S.scope_terms('parts[i]')} AS terms FROM
      (SELECT query_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT query_id, regexp_split_to_array(lower(query), '[\\t\\n\\f\\r ]+or[\\t\\n\\f\\r ]+') AS parts FROM bare))) WHERE len(terms) > 0),
  a AS MATERIALIZED (SELECT h.query_id, h.chunk_id, h.score FROM {Q.AND_HITS.replace(Q.ALTS, 'xalts')} h JOIN allowed USING (query_id, chunk_id)),
  o AS (SELECT h.query_id, h.chunk_id, h.score FROM {_OR} h JOIN allowed USING (query_id, chunk_id) WHERE query_id NOT IN (SELECT query_id FROM a)),
  whole AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS score FROM allowed WHERE query_id IN (SELECT query_id FROM scope) AND query_id IN (SELECT query_id FROM bare) AND query_id NOT IN (SELECT query_id FROM a)),
  lex AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
      (SELECT * FROM a UNION ALL SELECT * FROM o UNION ALL SELECT * FROM whole)) WHERE rank <= 100),
  titles AS (SELECT DISTINCT q.query_id, d.doc_id FROM {Q._sql_phrases(f"(SELECT query_id, {S.content_terms('query')} AS ws FROM xq)", 'query_id', 'ws', 2, 4)} q
      JOIN (SELECT doc_id, phrase FROM {Q._sql_phrases(f"(SELECT DISTINCT doc_id, {S.tokens('doc_name')} AS ws FROM xc)", 'doc_id', 'ws', 2, 4)}) d ON d.phrase = q.phrase
      JOIN xq ON xq.query_id = q.query_id JOIN (SELECT DISTINCT doc_id, org_id FROM xc) o ON o.doc_id = d.doc_id AND o.org_id = xq.org_id),
  scored AS MATERIALIZED (SELECT t.query_id, c.doc_id, c.chunk_id, length(c.s) AS n,
        coalesce(list_sum(list_transform({S.content_terms('q.query')}, lambda y: len(list_filter(c.ws, lambda x: contains(x, y))))), 0) AS score
      FROM titles t JOIN xq q ON q.query_id = t.query_id
      JOIN (SELECT chunk_id, doc_id, s, {S.tokens('s')} AS ws FROM (SELECT chunk_id, doc_id, {S.searchable('content')} AS s FROM xc) WHERE length(s) >= 20) c ON c.doc_id = t.doc_id),
  named AS (SELECT query_id, doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, n DESC, chunk_id) AS r FROM scored) WHERE r <= 5),
  inner_named AS (SELECT query_id, doc_id, chunk_id, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, n DESC, chunk_id) AS r FROM scored SEMI JOIN lex USING (query_id, chunk_id)) WHERE r <= 5),
  texts AS (SELECT query_id, chunk_id, rank FROM lex WHERE rank <= 50 UNION ALL
      SELECT query_id, chunk_id, 50 + row_number() OVER (PARTITION BY query_id ORDER BY doc_id, r, chunk_id) FROM inner_named ANTI JOIN (SELECT * FROM lex WHERE rank <= 50) l USING (query_id, chunk_id)),
  vecs AS (SELECT * FROM (SELECT h.query_id, h.item_id AS chunk_id, h.score AS vector_score, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.item_id) AS rank
      FROM {Q.SIM} h JOIN allowed w ON w.query_id = h.query_id AND w.chunk_id = h.item_id) WHERE rank <= 50),
  fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank, max(vector_score) AS vector_score FROM
      (SELECT query_id, chunk_id, rank, vector_score FROM vecs UNION ALL SELECT query_id, chunk_id, rank, NULL FROM texts) GROUP BY ALL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, chunk_id) AS rank FROM fused) WHERE rank <= 25),
  cands AS MATERIALIZED (SELECT query_id, chunk_id, rrf, vector_score, rank FROM best UNION ALL SELECT query_id, chunk_id, NULL, NULL, NULL FROM named ANTI JOIN best USING (query_id, chunk_id)),
  facts AS (SELECT c.*, x.doc_id, x.parent_headings, q.topic, q.target_document FROM cands c JOIN xc x ON x.chunk_id = c.chunk_id JOIN xq q ON q.query_id = c.query_id),
  wanted AS (SELECT DISTINCT query_id, topic FROM facts WHERE target_document IS NOT NULL AND {_IN_SCOPE}),
  siblings AS (SELECT d.query_id, x.chunk_id FROM (SELECT DISTINCT f.query_id, f.doc_id, w.topic FROM facts f JOIN wanted w ON w.query_id = f.query_id) d JOIN xc x ON x.doc_id = d.doc_id
      WHERE {_IN_SCOPE})
  SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score, round(vector_score, 6) AS vector_score, rank, false AS section_scope_match FROM cands
  UNION ALL SELECT query_id, chunk_id, NULL, NULL, NULL, true FROM siblings ANTI JOIN cands USING (query_id, chunk_id)"""


@query("scoped_hybrid_search", "RET-17 RET-4 RET-14 RET-24 SET-2 JOIN-11 FLT-8 TOP-4", SCOPED_HYBRID)
def scoped_hybrid_search(spark, folder):
    from lectern.operators.retrieval import hybrid_search

    rows = hybrid_search(
        scoped_queries(spark, folder), Q.query_vectors(spark, folder), book_chunks(spark, folder), Q.item_vectors(spark, folder)
    )
    return rows.select(
        "query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("vector_score", 6).alias("vector_score"),
        F.col("rank").cast("bigint").alias("rank"), "section_scope_match",
    )
