"""The same results in SQL (DuckDB), where SQL can express them."""

from __future__ import annotations

# Base32 digit j of the SHA-1 is 5 bits of the (j // 8)-th group of 5 bytes.
OP6 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(p.h, 1 + 10 * (j // 8), 10))::BIGINT >> (35 - 5 * (j % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN g ON p.h = g.h
"""

OP9 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE
    WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ') || ' ' || len(words)] ELSE [] END AS grams
  FROM w),
k AS (SELECT doc_id, len(grams) AS n, md5(array_to_string(list_sort(grams), '|')) AS key, grams FROM s),
c AS (SELECT key, min(doc_id) AS a, any_value(n) AS n, any_value(grams) AS grams FROM k WHERE n > 0 GROUP BY key),
t AS (SELECT a, n, unnest(grams) AS g FROM c),
l AS (
  SELECT x.a AS a, y.a AS b FROM t x JOIN t y ON x.g = y.g AND x.a < y.a
  GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, k.n AS n_shingles, coalesce(least, doc_id) AS component_id
FROM k LEFT JOIN c ON k.n > 0 AND k.key = c.key LEFT JOIN m ON c.a = m.a
"""


def _clusters(k: int = 8, rounds: int = 10) -> str:
    """Each round as tables of its own: the assignment and the moved centroids."""
    steps = [f"""v AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x
      FROM v QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
      SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT v.row, c.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d
        FROM v CROSS JOIN c{r} c)
      GROUP BY row)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
      SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT a.c, unnest(v.x) AS e, unnest(range(1, 65)) AS i FROM a{r} a JOIN v USING (row)) GROUP BY c, i),
    c{r + 1} AS MATERIALIZED (
      SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c) m ON c.c = m.c)""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON a.c = c.c"""


OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, s, w[i:i + s - 1] AS phrase FROM (
  SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p, range(1, 6) t(s))),
f AS MATERIALIZED (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY lang, s, phrase HAVING count(*) >= 100),
i AS (SELECT lang, f, unnest([phrase[1:s - 1], phrase[2:s]]) AS phrase FROM f WHERE s > 2),
d AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN i ON f.lang = i.lang AND f.phrase = i.phrase AND i.f >= f.f),
c AS (
  SELECT x.lang, x.phrase, k, x.f AS a, l.f AS l, r.f AS r, n.n, CAST(1000 * x.f::HUGEINT * n.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT f.*, unnest(range(1, s)) AS k FROM f ANTI JOIN d USING (lang, phrase) WHERE s > 1) x
  JOIN f l ON l.lang = x.lang AND l.phrase = x.phrase[1:k] JOIN f r ON r.lang = x.lang AND r.phrase = x.phrase[k + 1:x.s]
  JOIN n ON n.lang = x.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
  array_to_string(phrase, ' ') AS phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""

OP13 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

ORACLES: dict[str, str] = {
    "op6_warc_archive": OP6, "op9_shingle_jaccard_join": OP9, "op11_orchard_clustering": _clusters(), "op12_phrase_collocations": OP12,
    "op13_exact_dedup": OP13,
}
