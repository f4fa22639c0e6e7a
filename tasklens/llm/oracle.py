"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from tasklens.llm import license_scan as lic

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

URLS = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1),
                        '^[^?#]*') AS path
  FROM p),
rules(h, pre, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT url, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS v
  FROM (SELECT DISTINCT url, host, path FROM q) u
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
  GROUP BY url),
found AS (
  SELECT url, regexp_extract(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>') AS link,
         regexp_extract(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') AS meta
  FROM pages WHERE url IS NOT NULL),
target AS (
  SELECT url, coalesce(nullif(regexp_extract(link, '(?is)\bhref\s*=\s*"\s*([^"]*?)\s*"', 1), ''),
                       nullif(regexp_extract(link, '(?is)\bhref\s*=\s*''\s*([^'']*?)\s*''', 1), ''),
                       regexp_extract(link, '(?is)\bhref\s*=\s*([^\s"''>]+)', 1)) AS t FROM found
  UNION
  SELECT url, regexp_extract(meta, '(?is)\burl\s*=\s*["'']?\s*([^"''>\s;]+)', 1) FROM found),
goal AS (
  SELECT url, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN regexp_matches(t, '^(?:$|#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^[^:/?#]*') || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || t
    ELSE regexp_replace(regexp_extract(url, '^[^:/?#]*://[^/?#]*(?:/[^?#]*/)?'), '/$', '') || '/' || t END AS g
  FROM target),
node AS (
  SELECT u, nullif(translate(regexp_extract(u, '(?s)^.*?://([^/?#]+)/?([^#]*)', 1), '{UPPER}', '{LOWER}') || '/' ||
                   regexp_extract(u, '(?s)^.*?://([^/?#]+)/?([^#]*)', 2), '/') AS n
  FROM (SELECT url AS u FROM pages UNION SELECT g FROM goal) x WHERE u IS NOT NULL),
edge AS (
  SELECT DISTINCT a.n AS a, b.n AS b FROM goal JOIN node a ON a.u = url JOIN node b ON b.u = g WHERE a.n <> b.n),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (
  SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
alias AS (
  SELECT r.a AS n, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v
  FROM reach r JOIN node ON node.n = r.b JOIN best ON best.url = node.u GROUP BY r.a)
SELECT page_id, host, path, rule, coalesce(best.v, alias.v, 'allow') AS verdict,
       CASE WHEN best.v IS NOT NULL THEN 'rule' WHEN alias.v IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM q LEFT JOIN best ON best.url = q.url LEFT JOIN node ON node.u = q.url LEFT JOIN alias ON alias.n = node.n
"""


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(len(w) - {len(words) - 1}), lambda i: {same})"


def licenses() -> str:
    phrases = list(lic.PHRASES.items())
    at = ", ".join(f"{_places(p)} AS p{i}" for i, (p, _) in enumerate(phrases))
    every = " || ".join(f"p{i}" for i in range(len(phrases)))
    labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{x}' END" for i, (_, x) in enumerate(phrases))
    notices = ", ".join(f"('{n}', string_split('{' '.join(b.split())}', ' '))"
                        for n, b in sorted(lic.TEMPLATES.items()))
    gram = " || ' ' || ".join(f"w[pos + {k + 1}]" for k in range(lic.K))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (
  SELECT rid, pos, {gram} AS gram FROM (
    SELECT rid, w, unnest(range(len(w) - {lic.K - 1})) AS pos FROM d) x),
notice(template, w) AS (VALUES {notices}),
t AS (
  SELECT template, n, pos AS tpos, {gram} AS gram FROM (
    SELECT template, w, len(w) AS n, unnest(range(len(w) - {lic.K - 1})) AS pos FROM notice) x),
v AS (
  SELECT rid, template, n, pos - tpos AS diag, list(DISTINCT tpos) AS held FROM g JOIN t USING (gram)
  GROUP BY rid, template, n, pos - tpos),
s AS (
  SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, template ORDER BY diag) <= {lic.GAP}
                 THEN 0 ELSE 1 END AS fresh FROM v),
r AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diag) AS run FROM s),
c AS (
  SELECT rid, template, len(list_distinct(flatten(list_transform(
    flatten(list(held)), lambda x: range(x, x + {lic.K}))))) / max(n) AS share
  FROM r GROUP BY rid, template, run),
own AS (
  SELECT rid, list(template) AS found, max(share) AS share FROM c WHERE share >= {lic.COVER} GROUP BY rid),
b AS (SELECT rid, doc_id, len(w) AS n_words, {at} FROM d),
e AS (
  SELECT rid, doc_id, n_words, {every} AS places,
         list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM b)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM e LEFT JOIN own USING (rid)
"""


def clusters(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Rounds unrolled: ``c0`` holds the first centroids, ``a{i}`` the vectors
    assigned to ``c{i}``, ``c{i+1}`` the floored means."""
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    ctes = [f"""
v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v FROM v WHERE vec_id IS NOT NULL
  ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""
d{i} AS (SELECT rid, vec_id, v.v, cluster, {square} AS distance FROM v CROSS JOIN c{i} c),
a{i} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS nth FROM d{i}) x
  WHERE nth = 1)""")
        if i < rounds:
            ctes.append(f"""
m{i} AS (
  SELECT cluster, place, sum(x) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS place FROM a{i}) x GROUP BY cluster, place),
c{i + 1} AS (
  SELECT c.cluster, coalesce(new.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT cluster, list((CAST(s AS HUGEINT) - (((CAST(s AS HUGEINT) % n) + n) % n)) // n ORDER BY place) AS v
    FROM m{i} GROUP BY cluster) new ON new.cluster = c.cluster)""")
    return f"""
WITH {",".join(ctes)}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
"""


ORACLE = {
    "op1_top_k_search": TOP_K,
    "op4_url_filters": URLS,
    "op10_license_scans": licenses(),
    "op13_centroid_clustering": clusters(),
}
