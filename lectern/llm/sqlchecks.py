"""DuckDB SQL that computes the same rows as the queries, by plain means."""

from __future__ import annotations

from lectern.llm import shards


def sharding(n_shards: int, seed: int) -> str:
    """Row numbers by a window, the network by one column set a round, cycle walking by recursion."""
    rounds = []
    source = "w"
    for k, (m, c, m2) in enumerate(shards.round_keys(seed)):
        seen = "r" if k % 2 == 0 else "l"
        first = f"(({seen} * {m} + {c}) % {shards.PRIME})"
        t = f"((xor({first}, {first} >> 15) * {m2}) % {shards.PRIME})"
        moved = f"(l + {t}) % a AS l, r" if k % 2 == 0 else f"l, (r + {t}) % b AS r"
        source = f"(SELECT id, n, a, b, {moved} FROM {source})"
        rounds.append(source)
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT doc_id, strlen(text)::BIGINT + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])))::BIGINT AS text_crc32
  FROM d, crc
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS id, count(*) OVER () AS n FROM sized
), shaped AS (
  SELECT id, n, CASE WHEN n = 1 THEN 1 ELSE floor(sqrt(n - 1))::BIGINT + 1 END AS a FROM numbered
), walk AS (
  SELECT id, n, a, (n + a - 1) // a AS b, id AS pos, 0 AS step FROM shaped
  UNION ALL
  SELECT id, n, a, b, r * a + l AS pos, 1 AS step
  FROM (SELECT * FROM {rounds[-1].replace("FROM w)", "FROM (SELECT id, n, a, b, pos % a AS l, pos // a AS r FROM walk WHERE step = 0 OR pos >= n))")})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos % {n_shards})::INTEGER AS shard, pos // {n_shards} AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN (SELECT id, pos FROM walk WHERE step = 1 AND pos < n) USING (id)
"""


def words_of(text: str) -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


def decontamination(size: int) -> str:
    """Windows of items and of documents as strings, joined by equality."""
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, {words_of("text")} AS w FROM documents
), items AS (
  SELECT item_id, {words_of("text")} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least({size}, len(w)) AS n, array_to_string(list_slice(w, i, i + least({size}, len(w)) - 1), ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {size}, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT row_no, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT row_no, i, n, item_id FROM places JOIN windows USING (n, words)
), hit_words AS (
  SELECT row_no, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT row_no, unnest(range(i, i + n)) AS k FROM hits) GROUP BY row_no
), named AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row_no) LEFT JOIN named USING (row_no)
"""


def vector_codes(parts: int, entries: int, rounds: int) -> str:
    """Every distance of every part to every entry, round after round; codebooks as one row a part and entry."""
    steps = [f"""points AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS row_no, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
), cut AS MATERIALIZED (
  SELECT row_no, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS v
  FROM points, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
  SELECT p, row_no - 1 AS entry, v AS c FROM cut WHERE row_no <= {entries}
)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT row_no, p, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': entry}}) AS best
  FROM cut JOIN book{k} USING (p) GROUP BY row_no, p
)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(moved, c) AS c FROM book{k} LEFT JOIN (
    SELECT p, entry, list(mean ORDER BY i) AS moved FROM (
      SELECT p, entry, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS mean FROM (
        SELECT p, best.e AS entry, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM cut))) AS i)
        GROUP BY p, best.e, i))
    GROUP BY p, entry) USING (p, entry)
)""")
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT row_no, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row_no
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM book{rounds}) AS codebooks_sha256
FROM points JOIN coded USING (row_no)
"""
