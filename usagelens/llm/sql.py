"""DuckDB SQL for the results of operators that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1),
                                                  lambda i: array_to_string(ws[i:i + 4], ' '))) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
           FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM shared WHERE 100 * k >= 80 * (n + m - k)),
r(node, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u),
low AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, low.component_id FROM s JOIN low ON s.doc_id = low.node
"""


def clusters(dim: int, k: int, rounds: int, scale: int, seed: int) -> str:
    """Integer k-means, one pair of CTEs a round."""
    distance = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    ctes = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""", f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY mark) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('{seed}:' || vec_id) AS mark, v FROM kept ORDER BY mark LIMIT {k}))"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, cluster, d FROM (SELECT vec_id, v, cluster, {distance} AS d FROM kept, c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)""")
        if r < rounds:
            ctes.append(f"""m{r} AS (
  SELECT cluster, list(x ORDER BY i) AS c FROM (
    SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, list_transform(coalesce(m{r}.c, c{r}.c), lambda x: CAST(x AS BIGINT)) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


def contamination(window: int) -> str:
    """Item windows met by document windows of the same length, joined as texts."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    gram = "array_to_string(ws[i:i + n - 1], ' ')"
    return f"""
WITH b AS (SELECT item_id, {words} AS ws FROM benchmark),
bn AS (SELECT item_id, ws, least(len(ws), {window}) AS n FROM b WHERE len(ws) > 0),
bi AS (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bn),
wins AS MATERIALIZED (SELECT DISTINCT item_id, n, {gram} AS gram FROM bi),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
dn AS (SELECT rid, ws, n FROM d, (SELECT DISTINCT n FROM wins) WHERE len(ws) >= n),
di AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dn),
hits AS MATERIALIZED (SELECT rid, i, n, item_id FROM (SELECT rid, i, n, {gram} AS gram FROM di) JOIN wins USING (n, gram)),
hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def revisits(alphabet: str) -> str:
    """Records by payload; the digest's base32 in groups of five hex digits, four letters each."""
    letters = " || ".join(f"substr('{alphabet}', ((CAST('0x' || substr(hex, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)"
                          for g in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT page_id, strlen(payload) AS n, hex, row_number() OVER same AS place, first_value(page_id) OVER same AS to_page
      FROM p WINDOW same AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN to_page END AS refers_to
FROM r
"""
