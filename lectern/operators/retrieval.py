"""Candidates for a table of queries: fusion, named documents, scopes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.functions.patterns import jvm
from lectern.operators import lexical as L
from lectern.operators.ranking import top_per_group
from lectern.operators.vectors import top_similar
from lectern.session import kept, modest


# ---- fusion -----------------------------------------------------------------
def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, keep: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists.

    Vector hits are (query_id, item_id, score, rank), lexical hits (query_id,
    chunk_id, rank). Ties: better best rank, then id.
    """
    legs = vector_hits.select(
        "query_id", F.col("item_id").alias("chunk_id"), "rank", F.col("score").alias("vector_score")
    ).unionByName(lexical_hits.select("query_id", "chunk_id", "rank", F.lit(None).cast("double").alias("vector_score")))
    fused = legs.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(fixed.RRF_K) + F.col("rank"))).alias("rrf_score"),
        F.min("rank").alias("best_rank"),
        F.max("vector_score").alias("vector_score"),
    )
    return top_per_group(fused, ["query_id"], [F.desc("rrf_score"), F.col("best_rank"), F.col("chunk_id")], keep)


# ---- documents named in the query -------------------------------------------
def named_scores(
    queries: DataFrame, chunks: DataFrame, group: str | None = None, among: DataFrame | None = None
) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, n) of every chunk of every document that a query names.

    ``chunks`` has chunk_id, doc_id, doc_name and content; ``n`` is the length of the
    searchable text. With ``group`` both sides must agree in it. With ``among``
    (query_id, doc_id) only those pairs are looked at.
    """
    documents = chunks.select("doc_id", "doc_name", *([group] if group else [])).distinct()
    named = L.title_matches(queries, documents, group, among)
    asked = queries.select("query_id", F.array_join(T.content_terms(F.col("query")), " ").alias("terms"))
    pairs = kept(named.select("query_id", "doc_id").join(asked, "query_id"), "asked")
    # Only chunks of a named document are cleaned.
    clean = (
        chunks.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
        .withColumn("clean", T.searchable_text(F.col("content")))
        .filter(F.length("clean") >= fixed.MIN_SEARCHABLE_CHARS)
    )
    lines = clean.select("doc_id", "chunk_id", F.length("clean").alias("n"), F.array_join(T.tokens(F.col("clean")), " ").alias("words"))
    # A chunk meets the queries of its document some at a time: no row grows with a document or with the queries.
    sizes = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
    piece = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("size") / ASKED_AT_ONCE)).alias("piece")
    some = pairs.join(sizes, "doc_id").select("doc_id", piece, F.struct("query_id", "terms").alias("q"))
    met = lines.join(some.groupBy("doc_id", "piece").agg(F.collect_list("q").alias("asked")), "doc_id")
    met = met.select("doc_id", "chunk_id", "n", "words", "piece", "asked")
    kinds = {name: kind for name, kind in [*pairs.dtypes, *chunks.select("chunk_id").dtypes]}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, chunk_id {kinds['chunk_id']}, score bigint, n int"

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["query_id", "doc_id", "chunk_id", "score", "n"]
        groups: dict = {}
        for batch in batches:
            rows = []
            for doc, chunk, n, words, piece, asked in batch.itertuples(index=False):
                if (doc, piece) not in groups:
                    if len(groups) >= 16:
                        groups.clear()
                    wanted = [(q["query_id"], q["terms"].split()) for q in asked]
                    groups[doc, piece] = wanted, TermCounts(t for _, terms in wanted for t in terms)
                wanted, count = groups[doc, piece]
                found = count(words.split())
                rows += [(query, doc, chunk, sum(found[t] for t in terms), n) for query, terms in wanted]
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return modest(met).mapInPandas(scored, schema)


#: Queries of a document that a chunk meets in one row.
ASKED_AT_ONCE = 256


class TermCounts:
    """In how many words of a line each of some terms stands.

    A word is looked at once: its substrings (searchable words are under 32 letters)
    are looked up among the terms, so no term meets every word.
    """

    def __init__(self, terms: Iterable[str]):
        self.terms = set(terms)
        self.sizes = range(min(map(len, self.terms), default=1), max(map(len, self.terms), default=0) + 1)
        self.seen: dict[str, tuple[str, ...]] = {}

    def within(self, word: str) -> tuple[str, ...]:
        if word not in self.seen:
            if len(self.seen) >= 100_000:
                self.seen.clear()
            cuts = {word[i : i + n] for n in self.sizes for i in range(len(word) - n + 1)}
            self.seen[word] = tuple(c for c in cuts if c in self.terms)
        return self.seen[word]

    def __call__(self, words: list[str]) -> Counter:
        out: Counter = Counter()
        for word, times in Counter(words).items():
            for term in self.within(word):
                out[term] += times
        return out


def counts_in_words(terms: list[str], lines: list[list[str]]) -> list[int]:
    """Pairs of a term and a word of each line where the word contains the term, repeats counted again."""
    count = TermCounts(terms)
    return [sum(found[t] for t in terms) for found in map(count, lines)]


def best_named(scored: DataFrame, per_document: int = 5, hits: DataFrame | None = None) -> DataFrame:
    """Best few scored chunks of each query and document; with ``hits`` (query_id, chunk_id) among those only."""
    if hits is not None:
        scored = scored.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return top_per_group(scored, ["query_id", "doc_id"], [F.desc("score"), F.desc("n"), F.col("chunk_id")], per_document)


def named_document_rows(
    queries: DataFrame, chunks: DataFrame, per_document: int = 5, hits: DataFrame | None = None, group: str | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """Best few chunks of every document that a query names.

    Longer text first among equal scores. With ``hits`` (query_id, chunk_id) a query
    chooses among its own hits only, so its rows do not depend on the other queries.
    ``group`` and ``among`` as in ``named_scores``.
    """
    return best_named(named_scores(queries, chunks, group, among), per_document, hits)


def with_named_rows(selected: DataFrame, named: DataFrame, after: int | None = None) -> DataFrame:
    """Selected (query_id, chunk_id, rank, ...) plus named rows that are not in it yet.

    With ``after``, the added rows are ranked one after the other from ``after + 1``.
    """
    keys = ["query_id", "chunk_id"]
    extra = named.join(selected.select(*keys), keys, "left_anti")
    if after is None:
        return selected.unionByName(extra.select(*keys), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "rank", "chunk_id"))
    return selected.unionByName(extra.select(*keys, (place + after).alias("rank")), allowMissingColumns=True)


# ---- scopes -----------------------------------------------------------------
def _name_pattern(target: Column, flags: str = "") -> Column:
    """A name as whole words. The name comes first, as plain letters are found sooner than a boundary."""
    return F.concat(F.lit(flags + r"\Q"), target, F.lit(r"\E(?![A-Za-z0-9_])(?<![A-Za-z0-9_]\Q"), target, F.lit(r"\E)"))


def without_name(query: Column, target: Column) -> Column:
    """Query text without the name of its target document."""
    cut = F.regexp_replace(query, _name_pattern(target, "(?i)"), F.lit(" "))
    has_target = target.isNotNull() & ~target.isin("", "null")
    return F.when(has_target, T.collapse(cut)).otherwise(query)


def query_topic(query: Column, target: Column) -> Column:
    """What is asked about, without lead verbs, fillers and the document name."""
    out = F.lower(F.coalesce(query, F.lit("")))
    for pattern in fixed.TOPIC_NOISE:
        out = T.rx(out, pattern, " ")
    named = F.regexp_replace(out, _name_pattern(F.lower(target)), F.lit(" "))
    out = F.when(target.isNotNull() & (target != ""), named).otherwise(out)
    return T.blank_to_null(T.collapse(F.regexp_replace(out, F.lit("[^a-z0-9]+"), F.lit(" "))))


def retrieval_text(query: Column, wants_file: Column) -> Column:
    """Query without delivery and format words when a file is asked for."""
    out = query
    for pattern in fixed.RETRIEVAL_NOISE:
        out = T.rx(out, pattern, " ", "i")
    return F.when(wants_file, T.bind(T.collapse(out), lambda s: F.when(F.length(s) >= 3, s).otherwise(query))).otherwise(query)


def crosses_documents(query: Column) -> Column:
    return T.matches(query, fixed.CROSS_DOCUMENT)


def scoped_documents(queries: DataFrame, documents: DataFrame, group: str | None = None) -> DataFrame:
    """(query_id, doc_id) of the scope of each scoped query, in its own group if one is named.

    ``active_document`` is an id; ``target_document`` a name fragment. A query
    across documents keeps an id scope but not a name scope.
    """
    by_id = queries.filter("active_document is not null").select("query_id", F.col("active_document").alias("doc_id"))
    by_name = queries.filter(
        F.col("active_document").isNull() & F.col("target_document").isNotNull()
        & ~F.col("target_document").isin("", "null") & ~crosses_documents(F.col("query"))
    ).select("query_id", F.trim("target_document").alias("fragment"))
    found = L.names_containing(by_name, documents)
    scope = by_id.join(documents.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id").unionByName(
        by_name.join(found, "fragment").select("query_id", "doc_id")
    )
    if group is None:
        return scope
    owned = scope.join(documents.select("doc_id", group), "doc_id")
    return owned.join(queries.select("query_id", group), ["query_id", group], "left_semi").select("query_id", "doc_id")


def scoped_search(
    queries: DataFrame, chunks: DataFrame, limit: int, group: str | None = None, scope: DataFrame | None = None
) -> DataFrame:
    """Text search with scopes (query_id, chunk_id, score, rank, leg).

    Scoped AND search; without a hit the whole scoped document in order; queries
    without a scope, or whose scope is empty, search everything. ``chunks`` has
    chunk_id, doc_id, doc_name, chunk_index and content. ``scope`` (query_id, doc_id) may be given
    where it is stored already.
    """
    worded = queries.filter(F.size(T.content_terms(F.col("query"))) > 0)
    if scope is None:
        documents = chunks.select("doc_id", "doc_name", *([group] if group else [])).distinct()
        scope = kept(scoped_documents(worded, documents, group), "scope")
    order = [F.desc("score"), F.col("chunk_index"), F.col("chunk_id")]

    # The name of the document need not stand in its chunks.
    bare = worded.withColumn(
        "query", F.coalesce(T.blank_to_null(without_name(F.col("query"), F.col("target_document"))), F.col("query"))
    )
    asked = bare.join(scope.select("query_id").distinct(), "query_id", "left_semi")
    # The scope already says which chunks a query may look into: those are tested, no others.
    inside = L.hits_in_documents(asked, chunks, scope)
    first = kept(top_per_group(inside, ["query_id"], order, limit), "scoped").withColumn("leg", F.lit("scoped"))

    dry = scope.join(
        asked.select("query_id").join(first.select("query_id").distinct(), "query_id", "left_anti"), "query_id", "left_semi"
    )
    # No query takes more than the first rows of a document.
    heads = top_per_group(
        chunks.select("doc_id", "chunk_id", "chunk_index").join(dry.select("doc_id").distinct(), "doc_id", "left_semi"),
        ["doc_id"], order[1:], limit,
    ).drop("rank")
    whole = heads.join(dry, "doc_id").select("query_id", "chunk_id", F.lit(1.0).alias("score"), "chunk_index")
    second = top_per_group(whole, ["query_id"], order, limit).withColumn("leg", F.lit("document"))

    both = first.unionByName(second).select("query_id", "chunk_id", "score", "rank", "leg")
    free = worded.join(scope.select("query_id").distinct(), "query_id", "left_anti")
    # Where every query has a scope, no index of all chunks is needed.
    if free.isEmpty():
        return both
    return both.unionByName(L.search(free, chunks, limit, group).select(*both.columns))


# ---- parent sections --------------------------------------------------------
def heading_in_scope(heading: Column, topic: Column) -> Column:
    """Every scope word stands in the heading."""
    return F.size(F.array_except(T.scope_terms(topic), T.scope_terms(heading))) == 0


def in_parent_scope(parents: Column, topic: Column) -> Column:
    asked = F.coalesce(F.size(T.scope_terms(topic)) > 0, F.lit(False))
    return asked & F.coalesce(F.exists(parents, lambda h: heading_in_scope(h, topic)), F.lit(False))


def parent_heading(evidence: DataFrame) -> DataFrame:
    """First matching parent heading per query, in rank order, the deepest of its row."""
    match = F.filter(F.reverse("parent_headings"), lambda h: heading_in_scope(h, F.col("topic")))
    hits = evidence.filter(in_parent_scope(F.col("parent_headings"), F.col("topic"))).withColumn("heading", F.get(match, F.lit(0)))
    return hits.groupBy("query_id").agg(F.min_by("heading", "rank").alias("heading"))


def with_parent_sections(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the sibling sections of a requested parent section.

    Queries with a target document and a candidate under the wanted heading get
    every chunk of their candidate documents under that heading. Candidates have
    query_id, chunk_id, doc_id, topic, target_document and parent_headings.
    """
    wanted = (
        candidates.filter(F.col("target_document").isNotNull() & in_parent_scope(F.col("parent_headings"), F.col("topic")))
        .select("query_id", "topic").distinct()
    )
    documents = candidates.select("query_id", "doc_id").distinct().join(wanted, "query_id")
    siblings = (
        chunks.join(documents, "doc_id")
        .filter(in_parent_scope(F.col("parent_headings"), F.col("topic")))
        .join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        .withColumn("section_scope_match", F.lit(True))
    )
    base = candidates.withColumn("section_scope_match", F.lit(False))
    shared = [c for c in base.columns if c in siblings.columns]
    return base.unionByName(siblings.select(*shared), allowMissingColumns=True)


# ---- the whole search -------------------------------------------------------
def _vector_leg(queries, query_vectors, items, places, scope, tenant, k) -> DataFrame:
    """Nearest items of each query in its tenant and, where it has one, its scope."""
    if tenant is None and scope is None and places is None:
        return top_similar(query_vectors, items, k)
    placed = items.select("item_id", "vector").join(places, "item_id")
    asked = query_vectors.select("query_id", "vector").join(queries.select("query_id", *([tenant] if tenant else [])), "query_id")
    if scope is None:
        return top_similar(asked, placed, k, group=tenant)
    limited = scope.select("query_id").distinct()
    free = top_similar(asked.join(limited, "query_id", "left_anti"), placed, k, group=tenant)
    # A scope is a list of documents: a query meets the blocks of each, and its best are taken from all of them.
    inside = asked.select("query_id", "vector").join(scope, "query_id")
    near = top_similar(inside, placed.select("item_id", "vector", "doc_id"), k, group="doc_id")
    return free.unionByName(near.select(*free.columns))


def hybrid_search(
    queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, item_vectors: DataFrame, k: int = fixed.TOP_K
) -> DataFrame:
    """Fused vector and text search with the rows of named documents.

    ``chunks`` has chunk_id, doc_id, doc_name and content. Optional columns limit
    what a query sees, before anything is ranked: ``status`` of chunks (READY only),
    ``org_id`` of both sides (must agree), ``active_document`` and
    ``target_document`` of queries (scope; needs chunk_index). With ``topic`` of
    queries and ``parent_headings`` of chunks, sibling sections are added at the
    end. Without any stored vector only the text search runs.
    """
    inner = max(2 * k, 50)
    places = None
    if "status" in chunks.columns:
        chunks = chunks.filter(F.col("status") == "READY")
    tenant = "org_id" if "org_id" in chunks.columns and "org_id" in queries.columns else None
    own = [tenant] if tenant else []
    scoped = "target_document" in queries.columns and "active_document" in queries.columns
    if scoped or tenant or "status" in chunks.columns:
        places = chunks.select(F.col("chunk_id").alias("item_id"), "doc_id", *own)
    scope = None
    if scoped:
        documents = chunks.select("doc_id", "doc_name", *own).distinct()
        scope = kept(scoped_documents(queries, documents, tenant), "scope")
        lexical = kept(scoped_search(queries, chunks, max(2 * inner, 50), tenant, scope), "lexical")
    else:
        lexical = kept(L.search(queries, chunks, max(2 * inner, 50), tenant), "lexical")
    named = kept(named_scores(queries, chunks, tenant), "named")
    named_in_text = best_named(named, hits=lexical)
    ranked = lexical.select("query_id", "chunk_id", "rank")
    if item_vectors.isEmpty():
        # Named rows are added after the cut, as a reader asked for their documents.
        out = with_named_rows(ranked.filter(F.col("rank") <= k), named_in_text, k).withColumns(
            {"best_rank": F.col("rank"), "rrf_score": F.lit(None).cast("double"), "vector_score": F.lit(None).cast("double")}
        )
    else:
        text_leg = with_named_rows(ranked.filter(F.col("rank") <= inner), named_in_text, inner)
        vector_leg = _vector_leg(queries, query_vectors, item_vectors, places, scope, tenant, 2 * k)
        out = with_named_rows(fuse(vector_leg, text_leg, max(k, 25)), best_named(named))
    if "parent_headings" not in chunks.columns or not {"topic", "target_document"} <= set(queries.columns):
        return out
    facts = chunks.select("chunk_id", "doc_id", "parent_headings")
    asked = queries.select("query_id", "topic", "target_document")
    return with_parent_sections(out.join(facts, "chunk_id").join(asked, "query_id"), facts)


def retrieval_mode(intent: Column, has_prior: Column, bypass: Column) -> Column:
    return (
        F.when(intent == "DOWNLOAD", "DOWNLOAD")
        .when(has_prior, "CONTEXT_REF")
        .when(bypass, "ANAPHORA_BYPASS")
        .otherwise("NEW_RAG")
    )


def proper_topic(query: Column) -> Column:
    """Named work or entity asked for: two or more capitalised words after a lead verb."""
    found = F.regexp_extract(T.trim_all(F.coalesce(query, F.lit(""))), jvm(fixed.PROPER_TOPIC), 1)
    return T.blank_to_null(F.lower(found))
