"""Queries over vectors, text search, fusion and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import lexical as L
from lectern.operators import pivots as PV
from lectern.operators import postings as P
from lectern.operators import vectors as V
from lectern.operators import vectorlists as VL
from lectern.operators.ranking import top_per_group
from lectern.plans import derived as D
from lectern.plans import sqltext as S
from lectern.plans.registry import query, stored, table


# ---- shared inputs ----------------------------------------------------------
def queries_of(spark, folder):
    """The benchmark passages are the queries; each has the vector of the same id."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return vectors.join(queries_of(spark, folder).select("query_id"), "query_id", "left_semi")


def item_vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def document_chunks(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def document_index(spark, folder) -> P.Index:
    """The stored index of all documents, built by the first search."""
    return stored(spark, folder, "documents", lambda: P.build_index(document_chunks(spark, folder)))


QV = "(SELECT b.item_id AS query_id, e.embedding AS vector, e.label FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"
SIM = f"(SELECT q.query_id, e.vec_id AS item_id, q.label AS q_label, e.label, round({S.cosine('q.vector', 'e.embedding')}, 12) AS score FROM {QV} q, embeddings e)"


# ---- vectors ----------------------------------------------------------------
@query(
    "vector_topk", "RET-15 TOP-1 WIN-7 JOIN-6",
    f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {SIM}) WHERE rank <= 10""",
)
def vector_topk(spark, folder):
    return V.top_similar(query_vectors(spark, folder), item_vectors(spark, folder), 10).withColumns(
        {"rank": F.col("rank").cast("bigint"), "score": F.round("score", 6)}
    )


@query(
    "vector_topk_scoped", "TOP-1 FLT-9",
    f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {SIM} WHERE label = q_label) WHERE rank <= 10""",
)
def vector_topk_scoped(spark, folder):
    out = V.top_similar(query_vectors(spark, folder), item_vectors(spark, folder), 10, group="label")
    return out.withColumns({"rank": F.col("rank").cast("bigint"), "score": F.round("score", 6)})


@query("similar_pairs", "JOIN-7", f"SELECT query_id, item_id, round(score, 6) AS score FROM {SIM} WHERE score >= 0.25")
def similar_pairs(spark, folder):
    return V.similar_pairs(query_vectors(spark, folder), item_vectors(spark, folder), 0.25).withColumn(
        "score", F.round("score", 6)
    )


@query(
    "near_vectors", "JOIN-7",
    f"""WITH c AS (SELECT min(vec_id) AS vec_id, embedding, count(*) AS copies FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding)
        SELECT item_id, copies, count(*) AS links FROM (
          SELECT q.vec_id AS item_id, q.copies, round({S.cosine('q.embedding', 'e.embedding')}, 12) AS score FROM c q, c e) WHERE score >= 0.4 GROUP BY ALL""",
)
def near_vectors(spark, folder):
    """How many distinct vectors are near each one, itself included, by cells around pivots."""
    found = PV.classes(item_vectors(spark, folder))
    asked = found.select(F.col("item_id").alias("query_id"), "vector")
    links = PV.near_links(asked, found.select("item_id", "vector"), 0.4).withColumnRenamed("query_id", "item_id")
    return links.join(found.select("item_id", "copies"), "item_id").select("item_id", "copies", "links")


@query(
    "vector_classes", "JOIN-7",
    """SELECT vec_id AS item_id, CASE WHEN embedding IS NOT NULL THEN min(vec_id) OVER (PARTITION BY embedding) END AS class_id,
       CASE WHEN embedding IS NOT NULL THEN count(*) OVER (PARTITION BY embedding) END AS copies FROM embeddings""",
)
def vector_classes(spark, folder):
    """The distinct vector that every row belongs to."""
    return PV.members(item_vectors(spark, folder))


def vector_lists(spark, folder) -> VL.Lists:
    """The stored lists of all vectors, built by the first search."""
    return stored(spark, folder, "lists", lambda: VL.build_lists(item_vectors(spark, folder)))


@query("vector_list_search", "RET-16")
def vector_list_search(spark, folder):
    """As many lists as the recall of stored vectors asks for."""
    index = vector_lists(spark, folder)
    wanted = stored(spark, folder, "lists probed", lambda: VL.lists_for(index, 10))
    return VL.top_in_lists(index, query_vectors(spark, folder), 10, wanted)


@query(
    "vector_all_lists", "RET-16",
    f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {SIM}) WHERE rank <= 10""",
)
def vector_all_lists(spark, folder):
    """Every list probed: the index must then give the exact result."""
    index = vector_lists(spark, folder)
    out = VL.top_in_lists(index, query_vectors(spark, folder), 10, index.centres.count())
    return out.withColumns({"rank": F.col("rank").cast("bigint"), "score": F.round("score", 6)})


@query(
    "chunk_vectors", "JOIN-6",
    f"""SELECT c.doc_id, c.doc_name, e.label, CAST(len(e.embedding) AS BIGINT) AS dims FROM {S.CATALOG} c JOIN embeddings e ON e.vec_id = c.doc_id WHERE c.status = 'READY'""",
)
def chunk_vectors(spark, folder):
    ready = D.catalog(spark, folder).filter("status = 'READY'").select("doc_id", "doc_name")
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return ready.join(vectors, "doc_id").select("doc_id", "doc_name", "label", F.size("embedding").cast("bigint").alias("dims"))


@query(
    "vector_checks", "UDF-2",
    """SELECT vec_id, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AS numeric, len(embedding) = 64 AS dimension_ok,
       abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1.0) < 1e-3 AS unit_norm FROM embeddings""",
)
def vector_checks(spark, folder):
    return V.vector_checks(table(spark, folder, "embeddings"), "embedding", 64).select("vec_id", "numeric", "dimension_ok", "unit_norm")


@query(
    "grounding_share", "AGG-9",
    f"""SELECT answer_id, sentences, passing, round(passing / sentences, 6) AS share, passing / sentences >= {fixed.GROUNDING_SHARE} AS grounded FROM (
          SELECT q_label AS answer_id, count(*) AS sentences, CAST(count_if(best >= {fixed.GROUNDING_SENTENCE}) AS BIGINT) AS passing FROM (
            SELECT q_label, query_id, max(score) AS best FROM {SIM} WHERE label = q_label AND query_id <> item_id GROUP BY q_label, query_id)
          GROUP BY q_label)""",
)
def grounding_share(spark, folder):
    from lectern.operators.grounding import grounded_answers

    sentences = query_vectors(spark, folder).select(F.col("label").alias("answer_id"), F.col("query_id").alias("sentence_id"), "vector")
    evidence = item_vectors(spark, folder).select(F.col("label").alias("answer_id"), F.col("item_id").alias("evidence_id"), "vector")
    # A sentence may lean on any vector of its answer but itself.
    return grounded_answers(sentences, evidence, skip_same_id=True)


# ---- text -------------------------------------------------------------------
def _terms(x: str) -> str:
    return S.scope_terms(x)


INDEX = f"(SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY doc_id, term)"


@query(
    "term_statistics", "RET-1 TXT-1 TXT-2 RET-13",
    f"SELECT term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS occurrences FROM {INDEX} GROUP BY term",
)
def term_statistics(spark, folder):
    index = L.term_index(document_chunks(spark, folder))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"))


@query(
    "token_counts", "TXT-1 TXT-2 TXT-7",
    f"""SELECT doc_id, CAST(len({S.tokens('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({S.tokens('text')})) AS BIGINT) AS n_distinct,
        CAST(len({S.content_terms('text')}) AS BIGINT) AS n_content, CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_estimate FROM documents""",
)
def token_counts(spark, folder):
    text = F.col("text")
    return (
        table(spark, folder, "documents").select("doc_id", "text", T.tokens(text).alias("w"))
        .select(
            "doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
            F.size(F.filter("w", lambda t: ~t.isin(fixed.STOPWORDS))).cast("bigint").alias("n_content"),
            T.token_estimate(text).alias("token_estimate"),
        )
    )


# Alternatives ("or") of each query with their required stems.
ALTS = (
    "(SELECT query_id, alt, list_distinct(terms) AS terms FROM (SELECT query_id, i AS alt, "
    + _terms("parts[i]")
    + " AS terms FROM (SELECT query_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM "
    "(SELECT item_id AS query_id, regexp_split_to_array(lower(text), '[\\t\\n\\f\\r ]+or[\\t\\n\\f\\r ]+') AS parts FROM benchmark))) WHERE len(terms) > 0)"
)
AND_PAIRS = f"""(SELECT a.query_id, a.alt, i.chunk_id, any_value(a.terms) AS terms FROM (SELECT query_id, alt, terms, unnest(terms) AS term FROM {ALTS}) a
    JOIN {INDEX} i ON i.term = a.term GROUP BY a.query_id, a.alt, i.chunk_id HAVING count(*) = any_value(len(a.terms)))"""
# Minimal covers: for each occurrence, the span back to the earliest of the latest places of all terms.
AND_HITS = f"""(
  WITH pairs AS {AND_PAIRS},
  words AS (SELECT doc_id AS chunk_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, {S.tokens('text')} AS w FROM documents WHERE doc_id IN (SELECT chunk_id FROM pairs))),
  occ AS (SELECT p.query_id, p.alt, p.chunk_id, len(p.terms) AS n, w.pos, t.term FROM pairs p, (SELECT chunk_id, pos, {S.scope_stem('word')} AS term FROM words) w, (SELECT DISTINCT unnest(terms) AS term, query_id, alt FROM {ALTS}) t
          WHERE w.chunk_id = p.chunk_id AND t.query_id = p.query_id AND t.alt = p.alt AND t.term = w.term),
  ends AS (SELECT a.query_id, a.alt, a.chunk_id, a.n, a.pos AS e, b.term, max(b.pos) AS latest FROM occ a JOIN occ b
           ON a.query_id = b.query_id AND a.alt = b.alt AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL),
  spans AS (SELECT DISTINCT query_id, chunk_id, min(latest) AS s, e FROM ends GROUP BY query_id, alt, chunk_id, n, e HAVING count(*) = n),
  minimal AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE a.query_id = b.query_id AND a.chunk_id = b.chunk_id
              AND b.s >= a.s AND b.e <= a.e AND (b.s, b.e) <> (a.s, a.e)))
  SELECT query_id, chunk_id, round(sum(least(1.0, 16.0 / (e - s + 1))), 6) AS score FROM minimal GROUP BY query_id, chunk_id)"""
OR_HITS = f"""(SELECT q.query_id, i.chunk_id, CAST(sum(i.tf) AS DOUBLE) AS score FROM
    (SELECT query_id, unnest(list_distinct(list_transform(list_slice(terms, 1, 8), lambda st: {S.scope_stem('st')}))) AS term FROM
      (SELECT item_id AS query_id, {S.content_terms('text')} AS terms FROM benchmark)) q
    JOIN {INDEX} i ON i.term = q.term GROUP BY q.query_id, i.chunk_id)"""


def sql_search(limit: int, allowed: str = "") -> str:
    return f"""(
      WITH a AS (SELECT h.* FROM {AND_HITS} h {allowed}), o AS (SELECT h.* FROM {OR_HITS} h {allowed} WHERE query_id NOT IN (SELECT query_id FROM a))
      SELECT query_id, chunk_id, score, rank, leg FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
        (SELECT *, 'and' AS leg FROM a UNION ALL SELECT *, 'or' AS leg FROM o)) WHERE rank <= {limit})"""


@query("and_search", "RET-1 RET-2", f"SELECT query_id, chunk_id, score FROM {AND_HITS}")
def and_search(spark, folder):
    return L.and_hits(queries_of(spark, folder), document_chunks(spark, folder))


@query("or_search", "RET-3", f"SELECT query_id, chunk_id, score FROM {OR_HITS}")
def or_search(spark, folder):
    return L.or_hits(queries_of(spark, folder), document_chunks(spark, folder), fixed.OR_TERMS)


@query("lexical_search", "RET-1 RET-3 TOP-2", f"SELECT * FROM {sql_search(50)}")
def lexical_search(spark, folder):
    out = L.search(queries_of(spark, folder), document_chunks(spark, folder), 50)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


# Web-style queries from the benchmark's words: a phrase without a word, or two words.
def web_queries(spark, folder):
    w = lambda n: F.coalesce(F.get("w", F.lit(n - 1)), F.lit(""))
    text = F.concat(F.lit('"'), w(1), F.lit(" "), w(2), F.lit(" "), w(3), F.lit('" -'), w(9), F.lit(" or "), w(5), F.lit(" "), w(6))
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("w")).select("query_id", text.alias("query"))


def _sql_stems(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
    return f"list_transform({S.tokens(x)}, lambda st: CASE WHEN st IN ({stop}) THEN '' ELSE {S.scope_stem('st')} END)"


WEB_WORDS = f"(SELECT item_id AS query_id, list_transform(range(1, 10), lambda i: coalesce(w[i], '')) AS w FROM (SELECT item_id, {S.tokens('text')} AS w FROM benchmark))"
WEB_ALTS = f"""(SELECT query_id, alt, list_distinct(terms) AS terms, phrase, excluded FROM (
    SELECT query_id, 1 AS alt, {_terms("w[1] || ' ' || w[2] || ' ' || w[3]")} AS terms, ' ' || array_to_string({_sql_stems("w[1] || ' ' || w[2] || ' ' || w[3]")}, ' ') || ' ' AS phrase,
      {_terms("w[9]")} AS excluded FROM {WEB_WORDS}
    UNION ALL SELECT query_id, 2, {_terms("w[5] || ' ' || w[6]")}, '', [] FROM {WEB_WORDS}) WHERE len(terms) > 0)"""
WEB_PAIRS = f"""(SELECT p.* FROM {AND_PAIRS.replace(ALTS, WEB_ALTS)} p JOIN {WEB_ALTS} a USING (query_id, alt)
    JOIN (SELECT doc_id AS chunk_id, {_sql_stems('text')} AS stems FROM documents) s USING (chunk_id)
    WHERE contains(' ' || array_to_string(stems, ' ') || ' ', a.phrase) AND len(list_intersect(stems, a.excluded)) = 0)"""
WEB_HITS = AND_HITS.replace(AND_PAIRS, WEB_PAIRS).replace(ALTS, WEB_ALTS)
WEB_OR_HITS = OR_HITS.replace(
    f"(SELECT item_id AS query_id, {S.content_terms('text')} AS terms FROM benchmark)",
    f"(SELECT query_id, {S.content_terms("array_to_string([w[1], w[2], w[3], w[9], 'or', w[5], w[6]], ' ')")} AS terms FROM {WEB_WORDS})",
)


@query("indexed_search", "RET-1 RET-2 RET-3 TOP-2", f"SELECT * FROM {sql_search(50).replace(AND_HITS, WEB_HITS).replace(OR_HITS, WEB_OR_HITS)}")
def indexed_search(spark, folder):
    """Phrases, excluded words and alternatives over the stored index."""
    out = P.search(web_queries(spark, folder), document_index(spark, folder), 50)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "substring_scores", "RET-6 TOP-2",
    f"""WITH words AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens(S.searchable('text'))}) AS word FROM documents) GROUP BY ALL),
        asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({S.content_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
        bridge AS (SELECT t.term, v.word FROM (SELECT DISTINCT term FROM asked) t JOIN (SELECT DISTINCT word FROM words) v ON contains(v.word, t.term)),
        weights AS (SELECT a.query_id, b.word, sum(a.times) AS weight FROM asked a JOIN bridge b ON b.term = a.term GROUP BY ALL),
        scores AS (SELECT w.query_id, d.doc_id AS chunk_id, CAST(sum(w.weight * d.tf) AS BIGINT) AS score FROM weights w JOIN words d ON d.word = w.word GROUP BY ALL)
        SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores) WHERE rank <= 50""",
)
def substring_scores(spark, folder):
    scores = L.substring_scores(queries_of(spark, folder), document_chunks(spark, folder))
    top = top_per_group(scores, ["query_id"], [F.desc("score"), F.col("chunk_id")], 50)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


# ---- fusion -----------------------------------------------------------------
def sql_hybrid(allowed: str = "") -> str:
    return f"""(
  WITH v AS (SELECT query_id, chunk_id, rank, score AS vector_score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
        (SELECT h.* FROM (SELECT query_id, item_id AS chunk_id, score FROM {SIM}) h {allowed})) WHERE rank <= 50),
  l AS (SELECT query_id, chunk_id, rank FROM {sql_search(100, allowed)} WHERE rank <= 50),
  fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank, max(vector_score) AS vector_score
            FROM (SELECT query_id, chunk_id, rank, vector_score FROM v UNION ALL SELECT query_id, chunk_id, rank, NULL FROM l) GROUP BY ALL)
  SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score, round(vector_score, 6) AS vector_score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, chunk_id) AS rank FROM fused) WHERE rank <= 25)"""


HYBRID = sql_hybrid()
# A query asks for the tenant of the document with its id, and sees that tenant's finished documents.
ALLOWED = f"""JOIN (SELECT q.doc_id AS query_id, d.doc_id AS chunk_id FROM {S.CATALOG} q JOIN {S.CATALOG} d ON d.org_id = q.org_id AND d.status = 'READY') w USING (query_id, chunk_id)"""


def named_chunks(spark, folder):
    return D.docs(spark, folder).select(F.col("doc_id").alias("chunk_id"), "doc_id", "doc_name", F.col("text").alias("content"))


def hybrid_rows(spark, folder):
    from lectern.operators.retrieval import hybrid_search as search

    return search(
        queries_of(spark, folder), query_vectors(spark, folder), named_chunks(spark, folder), item_vectors(spark, folder)
    ).select(
        "query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("vector_score", 6).alias("vector_score"), F.col("rank").cast("bigint").alias("rank")
    )


@query("hybrid_search", "RET-17 SET-1 TOP-3 TOP-1", f"SELECT * FROM {HYBRID}")
def hybrid_search(spark, folder):
    return hybrid_rows(spark, folder)


@query("tenant_hybrid_search", "FLT-8 TOP-1 RET-17", f"SELECT * FROM {sql_hybrid(ALLOWED)}")
def tenant_hybrid_search(spark, folder):
    from lectern.operators.retrieval import hybrid_search as search

    catalog = D.catalog(spark, folder).select("doc_id", "org_id", "status")
    owner = catalog.select(F.col("doc_id").alias("query_id"), "org_id")
    chunks = named_chunks(spark, folder).join(catalog, "doc_id")
    return search(
        queries_of(spark, folder).join(owner, "query_id"), query_vectors(spark, folder), chunks, item_vectors(spark, folder)
    ).select(
        "query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("vector_score", 6).alias("vector_score"), F.col("rank").cast("bigint").alias("rank")
    )


# Queries that name documents: one per labelled document.
NAMED_Q = """(SELECT l.doc_id AS query_id, CASE WHEN l.quality = 1 THEN concat('Tell me about the ', d.lang, ' ', d.source, ' ', d.doc_id, ' file: ', d.text)
    ELSE concat('Compare ', d.lang, ' ', d.source, ' and others: ', d.text) END AS query, d.lang, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def named_queries(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    about = F.concat(F.lit("Tell me about the "), F.col("lang"), F.lit(" "), F.col("source"), F.lit(" "), F.col("doc_id"), F.lit(" file: "), F.col("text"))
    compare = F.concat(F.lit("Compare "), F.col("lang"), F.lit(" "), F.col("source"), F.lit(" and others: "), F.col("text"))
    return (
        table(spark, folder, "documents").join(labels, "doc_id")
        .select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, about).otherwise(compare).alias("query"), "lang", "source")
    )


def _sql_phrases(source: str, key: str, words: str, shortest: int, longest: int) -> str:
    """All runs of adjacent words of a list column, as rows (key, phrase)."""
    leads = ", ".join(f"lead(w, {n}) OVER (PARTITION BY {key} ORDER BY i) AS w{n}" for n in range(1, longest))
    arms = " UNION ALL ".join(
        f"SELECT {key}, concat_ws(' ', w, {', '.join(f'w{k}' for k in range(1, n))}) AS phrase FROM led WHERE w{n - 1} IS NOT NULL"
        for n in range(shortest, longest + 1)
    )
    return f"""(WITH one AS (SELECT {key}, unnest({words}) AS w, unnest(range(len({words}))) AS i FROM {source}),
      led AS (SELECT *, {leads} FROM one) {arms})"""


QUERY_WORDS = f"(SELECT query_id, {S.content_terms('query')} AS ws FROM {NAMED_Q})"
NAME_WORDS = f"(SELECT doc_id, {S.tokens('doc_name')} AS ws FROM {S.DOCS})"
TITLE_MATCH = f"""(SELECT DISTINCT q.query_id, d.doc_id FROM (SELECT DISTINCT * FROM {_sql_phrases(QUERY_WORDS, 'query_id', 'ws', 2, 4)}) q
    JOIN (SELECT DISTINCT * FROM {_sql_phrases(NAME_WORDS, 'doc_id', 'ws', 2, 4)}) d ON d.phrase = q.phrase)"""
SCOPE_QUERY_WORDS = f"(SELECT query_id, {S.tokens("replace(query, source, 'src')")} AS ws FROM {NAMED_Q})"
SCOPE_NAME_WORDS = (
    "(SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(doc_name, '\\.[^.]+$', '')), '[a-z]+'), "
    f"lambda w: w NOT IN ('autorecovered', 'recovered')) AS ws FROM {S.DOCS})"
)


@query("title_matches", "RET-7", f"SELECT * FROM {TITLE_MATCH}")
def title_matches(spark, folder):
    return L.title_matches(named_queries(spark, folder), D.docs(spark, folder))


@query(
    "query_document_scope", "RET-18",
    f"""WITH d AS (SELECT phrase, min(doc_id) AS first_doc FROM {_sql_phrases(SCOPE_NAME_WORDS, 'doc_id', 'ws', 2, 5)} GROUP BY phrase),
        q AS (SELECT DISTINCT query_id, phrase FROM {_sql_phrases(SCOPE_QUERY_WORDS, 'query_id', 'ws', 2, 5)})
        SELECT query_id, arg_max(q.phrase, (length(q.phrase), -first_doc, q.phrase)) AS scope FROM q JOIN d ON d.phrase = q.phrase GROUP BY query_id""",
)
def query_document_scope(spark, folder):
    asked = named_queries(spark, folder).withColumn("query", F.replace("query", F.col("source"), F.lit("src")))
    return L.name_scope(asked, D.docs(spark, folder))


@query(
    "named_document_chunks", "TOP-4 SET-2",
    f"""WITH terms AS (SELECT query_id, {S.content_terms('query')} AS t FROM {NAMED_Q}),
        c AS (SELECT chunk_id, doc_id, s, {S.tokens('s')} AS w FROM (SELECT chunk_id, doc_id, {S.searchable('content')} AS s FROM {S.PARAGRAPHS}) WHERE length(s) >= 20),
        scored AS (SELECT m.query_id, c.doc_id, c.chunk_id, length(c.s) AS n,
            CAST(coalesce(list_sum(list_transform(t.t, lambda q: len(list_filter(c.w, lambda x: contains(x, q))))), 0) AS BIGINT) AS score
            FROM {TITLE_MATCH} m JOIN c ON c.doc_id = m.doc_id JOIN terms t ON t.query_id = m.query_id
            WHERE m.query_id = m.doc_id)
        SELECT query_id, doc_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, n DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5""",
)
def named_document_chunks(spark, folder):
    from lectern.operators.retrieval import named_document_rows

    asked = named_queries(spark, folder)
    # Each query names its own document; a name of its own makes the match one to one.
    own = D.docs(spark, folder).select("doc_id", "doc_name")
    chunks = D.paragraphs(spark, folder).join(own, "doc_id")
    pairs = asked.select("query_id", F.col("query_id").alias("doc_id"))
    rows = named_document_rows(asked, chunks, among=pairs)
    return rows.select("query_id", "doc_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "query_topics", "RET-19 RET-5 RET-20",
    f"""SELECT query_id, sha256({S.collapse("regexp_replace(t2, '[^a-z0-9]+', ' ', 'g')")}) AS topic_hash,
          sha256({S.collapse("regexp_replace(query, concat('(?i)\\b', lang, ' ', source, '\\b'), ' ', 'g')")}) AS bare_hash,
          sha256(CASE WHEN length(r) >= 3 THEN r ELSE query END) AS retrieval_hash
        FROM (SELECT query_id, query, lang, source, regexp_replace({S.rep(S.rep('lower(query)', fixed.TOPIC_NOISE[0], ' '), fixed.TOPIC_NOISE[1], ' ')}, concat('\\b', lang, ' ', source, '\\b'), ' ', 'g') AS t2,
              {S.collapse(S.rep(S.rep(S.rep(S.rep('query', fixed.RETRIEVAL_NOISE[0], ' ', 'i'), fixed.RETRIEVAL_NOISE[1], ' ', 'i'), fixed.RETRIEVAL_NOISE[2], ' ', 'i'), fixed.RETRIEVAL_NOISE[3], ' ', 'i'))} AS r
              FROM {NAMED_Q})""",
)
def query_topics(spark, folder):
    from lectern.operators import retrieval as R

    target = F.concat_ws(" ", "lang", "source")
    query_text = F.col("query")
    return named_queries(spark, folder).select(
        "query_id",
        F.sha2(R.query_topic(query_text, target), 256).alias("topic_hash"),
        F.sha2(R.without_name(query_text, target), 256).alias("bare_hash"),
        F.sha2(R.retrieval_text(query_text, F.lit(True)), 256).alias("retrieval_hash"),
    )


@query(
    "scoped_search", "RET-4 FLT-9",
    f"""WITH q AS (SELECT l.doc_id AS query_id, concat(d.lang, ' ', d.source, ' ', d.doc_id) AS target, l.quality,
            CASE WHEN l.quality = 1 THEN concat(d.lang, ' ', d.source, ' ', d.doc_id, ' ', string_split(d.text, chr(10))[1]) ELSE concat(d.lang, ' ', d.source, ' ', d.doc_id, ' zzunknownzz') END AS query
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
        scope AS (SELECT q.query_id, d.doc_id FROM q JOIN {S.DOCS} d ON contains(lower(d.doc_name), lower(q.target))),
        terms AS (SELECT query_id, list_distinct({S.scope_terms("replace(query, target, ' ')")}) AS t FROM q),
        alt AS (SELECT query_id, alt, list_distinct(t) AS t FROM (SELECT query_id, i AS alt, {S.scope_terms('parts[i]')} AS t FROM (SELECT query_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM
               (SELECT query_id, regexp_split_to_array(lower({S.collapse("replace(query, target, ' ')")}), ' or ') AS parts FROM q))) WHERE len(t) > 0),
        c AS (SELECT chunk_id, doc_id, chunk_index, list_distinct({S.scope_terms('content')}) AS w FROM {S.PARAGRAPHS}),
        hit AS (SELECT DISTINCT s.query_id, c.chunk_id FROM scope s JOIN c ON c.doc_id = s.doc_id JOIN alt ON alt.query_id = s.query_id WHERE list_has_all(c.w, alt.t)),
        whole AS (SELECT query_id, chunk_id FROM (SELECT s.query_id, c.chunk_id, row_number() OVER (PARTITION BY s.query_id ORDER BY c.chunk_index, c.chunk_id) AS rn
               FROM scope s JOIN c ON c.doc_id = s.doc_id WHERE s.query_id NOT IN (SELECT query_id FROM hit)) WHERE rn <= 500)
        SELECT query_id, chunk_id, 'scoped' AS leg FROM hit UNION ALL SELECT query_id, chunk_id, 'document' FROM whole""",
)
def scoped_search(spark, folder):
    from lectern.operators import retrieval as R

    labels = table(spark, folder, "labels").select("doc_id", "quality")
    name = F.concat_ws(" ", "lang", "source", F.col("doc_id").cast("string"))
    first_line = F.split("text", "\n")[0]
    asked = table(spark, folder, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("query_id"), name.alias("target_document"), F.lit(None).cast("bigint").alias("active_document"),
        F.when(F.col("quality") == 1, F.concat_ws(" ", name, first_line)).otherwise(F.concat_ws(" ", name, F.lit("zzunknownzz"))).alias("query"),
    )
    names = D.docs(spark, folder).select("doc_id", "doc_name")
    chunks = D.paragraphs(spark, folder).join(names, "doc_id")
    return R.scoped_search(asked, chunks, 500).select("query_id", "chunk_id", "leg")


# ---- evidence ---------------------------------------------------------------
def candidate_rows(spark, folder):
    """Hybrid candidates with their texts; some queries are scoped to a language."""
    docs = D.docs(spark, folder).select("doc_id", "doc_name", "text", "lang")
    asked = queries_of(spark, folder).select(
        "query_id", "query",
        F.when(F.col("query_id") % 3 == 0, "en src").when(F.col("query_id") % 7 == 1, "de src").alias("target_document"),
    )
    rows = hybrid_rows(spark, folder)
    return (
        rows.join(docs, F.col("chunk_id") == F.col("doc_id")).join(asked, "query_id")
        .select(
            "query_id", "query", "target_document", F.lit(None).cast("bigint").alias("active_document"),
            F.lit(None).cast("string").alias("topic"), "chunk_id", "doc_id", "doc_name", F.col("text").alias("content"),
            "vector_score", F.array().cast("array<string>").alias("parent_headings"), "rank", F.col("lang").alias("page"),
            F.lit(None).cast("int").alias("chunk_index"),
        )
    )


CANDIDATES = f"""(SELECT h.query_id, b.text AS query, CASE WHEN h.query_id % 3 = 0 THEN 'en src' WHEN h.query_id % 7 = 1 THEN 'de src' END AS target_document,
    h.chunk_id, d.doc_name, d.text AS content, h.vector_score, h.rank, d.lang AS page FROM {HYBRID} h JOIN {S.DOCS} d ON d.doc_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id)"""
JUDGED = f"""(WITH s AS (SELECT *, {S.searchable('content')} AS clean, coalesce(vector_score, 0) AS rel FROM {CANDIDATES}),
    t AS (SELECT *, length(clean) >= 20 AS searchable, max(CASE WHEN length(clean) >= 20 THEN rel END) OVER (PARTITION BY query_id) AS best FROM s),
    u AS (SELECT *, CASE WHEN target_document IS NOT NULL THEN greatest(0.05, best * 0.3) ELSE greatest(0.25, best - 0.15) END AS threshold,
          len(list_filter({S.content_terms('query')}, lambda q: len(list_filter(list_distinct({S.tokens('clean')}), lambda w: contains(w, q) OR contains(q, w))) > 0)) > 0 AS al FROM t)
    SELECT *, CASE WHEN NOT searchable THEN 'Chunk contains no searchable text'
       WHEN rel < threshold THEN printf('Low embedding similarity (%.3f < %.3f)', rel, threshold)
       WHEN target_document IS NOT NULL AND NOT {S.has('query', fixed.CROSS_DOCUMENT)} AND NOT contains(lower(doc_name), target_document)
         AND NOT contains(target_document, regexp_replace(lower(doc_name), '\\.[^/.]+$', '')) THEN concat('Document mismatch: expected ', target_document, ', got ', lower(doc_name))
       WHEN NOT (rel >= 0.35 OR (rel >= 0.18 AND al) OR (target_document IS NOT NULL AND al)) THEN 'Evidence does not align with the current query' END AS reject_reason FROM u)"""


@query(
    "evidence_selection", "WIN-5 FLT-13 RET-8 RET-9 RET-10 RET-11 SET-10",
    f"SELECT query_id, chunk_id, reject_reason IS NULL AS accepted, reject_reason FROM {JUDGED}",
)
def evidence_selection(spark, folder):
    from lectern.operators.evidence import judged

    return judged(candidate_rows(spark, folder)).select("query_id", "chunk_id", "accepted", "reject_reason")


@query(
    "overlap_selection", "RET-12",
    f"""WITH o AS (SELECT query_id, chunk_id, target_document, len(list_intersect(list_distinct({S.tokens('query')}), list_distinct({S.tokens('content')}))) / len(list_distinct({S.tokens('query')})) AS rel FROM {CANDIDATES}),
        b AS (SELECT *, max(rel) OVER (PARTITION BY query_id) AS best FROM o)
        SELECT query_id, chunk_id, round(rel, 6) AS relevance, rel >= greatest(CASE WHEN target_document IS NULL THEN 0.25 ELSE 0.12 END, best - 0.15) AS accepted FROM b""",
)
def overlap_selection(spark, folder):
    from lectern.operators.evidence import judged_by_overlap

    return judged_by_overlap(candidate_rows(spark, folder)).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "accepted")


@query(
    "evidence_budget", "WIN-4 SET-3",
    f"""WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY org_id, text ORDER BY doc_id) AS rn FROM {S.DOCS}),
        costed AS (SELECT org_id, doc_id, length(text) + length(doc_name) + 30 AS cost FROM firsts WHERE rn = 1),
        cum AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY org_id ORDER BY doc_id) AS BIGINT) AS total_chars, row_number() OVER (PARTITION BY org_id ORDER BY doc_id) AS place FROM costed)
        SELECT org_id, doc_id, CAST(cost AS BIGINT) AS cost, total_chars FROM cum WHERE total_chars <= 14000 OR place = 1""",
)
def evidence_budget(spark, folder):
    from lectern.operators.evidence import first_occurrences, within_budget

    rows = D.docs(spark, folder).select("org_id", "doc_id", "doc_name", F.col("text").alias("content"))
    kept = first_occurrences(rows, ["org_id"], F.sha2("content", 256), "doc_id")
    return within_budget(kept, "org_id", [F.col("doc_id")]).select(
        "org_id", "doc_id", F.col("cost").cast("bigint").alias("cost"), F.col("total_chars").cast("bigint").alias("total_chars")
    )


@query(
    "presentation_order", "WIN-6",
    f"""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY first_seen, chunk_index NULLS LAST, rank) AS place FROM (
          SELECT query_id, chunk_id, rank, CASE WHEN chunk_id % 4 = 0 THEN NULL ELSE chunk_id % 100 END AS chunk_index, min(rank) OVER (PARTITION BY query_id, page) AS first_seen FROM {CANDIDATES})""",
)
def presentation_order(spark, folder):
    from lectern.operators.evidence import presentation_order as order

    rows = candidate_rows(spark, folder).select(
        "query_id", "chunk_id", "rank", F.col("page").alias("doc_id"),
        F.when(F.col("chunk_id") % 4 != 0, F.col("chunk_id") % 100).alias("chunk_index"),
    )
    return order(rows).select("query_id", "chunk_id", F.col("place").cast("bigint").alias("place"))


@query(
    "evidence_sources", "AGG-8",
    f"""SELECT query_id, string_agg(page, ',' ORDER BY first_rank, page) AS sources FROM (SELECT query_id, page, min(rank) AS first_rank FROM {CANDIDATES} GROUP BY query_id, page) GROUP BY query_id""",
)
def evidence_sources(spark, folder):
    from lectern.operators.evidence import source_documents

    rows = candidate_rows(spark, folder).select("query_id", "rank", F.col("page").alias("doc_id"))
    return source_documents(rows).select("query_id", F.array_join("doc_ids", ",").alias("sources"))


@query(
    "evidence_text", "AGG-12 SET-6",
    f"""WITH p AS (SELECT query_id, doc_name, page, rank, i AS pos, {S.trim_all('parts[i]')} AS paragraph FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS parts FROM {CANDIDATES}))),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(left(paragraph, 50)) ORDER BY rank, pos) AS rn FROM p WHERE length(paragraph) >= 10)
        SELECT query_id, doc_name, page, CAST(min(rank) AS BIGINT) AS first_rank, sha256(string_agg(paragraph, chr(10) || chr(10) ORDER BY rank, pos)) AS body_hash FROM k WHERE rn = 1 GROUP BY query_id, doc_name, page""",
)
def evidence_text(spark, folder):
    from lectern.operators.evidence import evidence_document

    rows = candidate_rows(spark, folder).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return evidence_document(rows).select("query_id", "doc_name", "page", "first_rank", F.sha2("body", 256).alias("body_hash"))
