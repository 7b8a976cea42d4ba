"""DuckDB SQL for the queries whose results SQL can express; independent of the operators' methods."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ')
    ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS s
  FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

URL_FILTER = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@|:[0-9]*$', ''), '\.+$', ''), '^(?:www|m)\.', '') AS site,
    regexp_replace(regexp_replace(path, '(?:/index)?(?:\.html?|\.php)$', ''), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_source|utm_medium|utm_campaign|utm_term|utm_content|ref|fbclid|gclid)(?:=|$)'))) AS args FROM q),
u AS (SELECT *, CASE WHEN site <> '' THEN site || place || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canon FROM c),
l AS (SELECT canon FROM u WHERE canon IS NOT NULL GROUP BY canon HAVING count(*) > 1),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
r AS (
  SELECT u.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
FROM u LEFT JOIN r ON r.page_id = u.page_id LEFT JOIN l ON l.canon = u.canon
"""

_KINDS = (("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "(AKIA[A-Z0-9]+)", 1, 16), ("hex", "([0-9a-f]+)", 1, 32))

SECRET_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(f"SELECT doc_id, {r} AS r, '{kind}' AS kind, regexp_extract_all(t, '{x}', 0) AS ms, regexp_extract_all(t, '{x}', {g}) AS gs, string_split_regex(t, '{x}') AS ps, {least} AS least FROM d" for r, (kind, x, g, least) in enumerate(_KINDS))}),
e AS (
  SELECT doc_id, r, kind, length(ms[i]) AS n, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM m, unnest(range(1, len(ms) + 1)) AS u(i) WHERE length(gs[i]) >= least),
a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, r) AS spans, count(*) FILTER (r = 0) AS n0, count(*) FILTER (r = 1) AS n1, count(*) FILTER (r = 2) AS n2 FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

#: held: the documents that are held out, those whose crc32 of the id as text is divisible by ten. DuckDB has no crc32, so it is folded bit by bit.
LM_BASE = rf"""
WITH ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS x FROM documents),
crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x) + 1), lambda i: CAST(ord(substr(x, i, 1)) AS BIGINT))),
    lambda h, b: list_reduce(list_concat([xor(h, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT) % 10 = 0 AS held FROM ids),
w AS (SELECT d.doc_id, c.held, list_append({_WORDS}, NULL) AS ws FROM documents d JOIN crc c ON c.doc_id = d.doc_id),
t AS (SELECT doc_id, held, unnest(ws) AS word FROM w),
c AS (SELECT coalesce('w' || word, 'end') AS word, count(*) AS c FROM t WHERE NOT held GROUP BY 1),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT t.doc_id, t.held AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, n.n AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)))), 6) AS base_score
FROM t CROSS JOIN n LEFT JOIN c ON c.word = coalesce('w' || t.word, 'end') GROUP BY t.doc_id, t.held, n.n
"""

DEVIATIONS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT DISTINCT x FROM v),
s AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, CAST(sum(x[i]) AS BIGINT) AS s FROM u, unnest(range(1, len(x) + 1)) AS r(i) GROUP BY i)),
n AS (SELECT count(*) AS n FROM u)
SELECT vec_id, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation FROM v, s, n
"""
