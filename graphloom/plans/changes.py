"""Registered queries over changes of the model, exports, labels, states and extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, syntax
from ..operators import exports, graph, lifecycle, mutations, orders, resolve
from ..sources import state
from ..sources.extract import extract
from . import projections as m
from .catalog import CALLS_AND_EDGES, query

P, P2, I, K, O, R = m.SYMBOLS, m.SECOND, m.ITEMS, m.COLLECTIONS, m.NOTES, m.RUNS
_ID = "CAST(symbol_id AS BIGINT)"


def _id():
    return F.col("symbol_id").cast("bigint")


@query("create_notes", f"SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY repository_id, symbol_id) AS id, symbol_id, 'New' AS title, fqn AS symbol_fqn, 'linked' AS status FROM p WHERE {_ID} % 10 = 0", P, O)
def _(spark, d):
    notes, s = m.notes(spark, d), m.symbols(spark, d)
    asked = s.where(_id() % 10 == 0).select("repository_id", "symbol_id", F.lit("New").alias("title"))
    asked = asked.union(asked.select("repository_id", F.lit("gone"), "title"))  # refused: no such symbol
    return mutations.create_notes(notes, s, asked).where("title = 'New'").select("id", "symbol_id", "title", "symbol_fqn", "status")


@query("update_notes", "SELECT id, CASE WHEN id % 6 = 0 THEN 'Title ' || id ELSE title END AS title, CASE WHEN id % 6 = 0 THEN 'linked' ELSE status END AS status FROM o", P, O)
def _(spark, d):
    notes = m.notes(spark, d)
    asked = notes.where("id % 6 in (0, 1)").select("repository_id", F.when(F.col("id") % 6 == 0, F.col("symbol_id")).otherwise("gone").alias("symbol_id"), "id", F.concat(F.lit("Title "), F.col("id").cast("string")).alias("title"), F.lit("body").alias("body_markdown"), "tags")
    return mutations.update_notes(notes, m.symbols(spark, d), asked).select("id", "title", "status")


@query("save_notes", f"""SELECT coalesce(x.id, (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY x.id IS NULL ORDER BY p.repository_id, p.symbol_id)) AS id, p.symbol_id, coalesce(x.title, '기본 분석') AS title
FROM p LEFT JOIN (SELECT symbol_id, arg_max(id, (updated_at, id)) AS id, arg_max(title, (updated_at, id)) AS title FROM o WHERE status = 'linked' GROUP BY 1) x ON x.symbol_id = p.symbol_id WHERE {_ID.replace('symbol_id', 'p.symbol_id')} % 4 = 0""", P, O)
def _(spark, d):
    s = m.symbols(spark, d)
    asked = s.where(_id() % 4 == 0).select("repository_id", "symbol_id", F.lit("saved").alias("body_markdown"), F.array(F.lit("t")).alias("tags"))
    return mutations.save_notes(m.notes(spark, d), s, asked).where("body_markdown = 'saved'").select("id", "symbol_id", "title")


@query("note_search_rows", "SELECT repository_id, 'note' AS entity_type, CAST(id AS VARCHAR) AS entity_id, symbol_fqn || ' ' || title AS title, body_markdown AS content FROM o", P, O)
def _(spark, d):
    return mutations.search_rows(m.notes(spark, d))


def _repositories(spark, d):
    return m.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("head"), F.col("c_custkey").cast("string"))).alias("head"))


_REVISIONS = """cr AS (SELECT CAST(c_custkey AS VARCHAR) AS repository_id, coalesce(x.revision, CASE WHEN c_custkey % 2 = 0 THEN 'head' || c_custkey END, '') AS revision FROM customer
  LEFT JOIN (SELECT repository_id, arg_max(revision, id) AS revision FROM r WHERE status IN ('completed', 'partial') AND completed_at IS NOT NULL GROUP BY 1) x ON x.repository_id = CAST(c_custkey AS VARCHAR))"""


@query("collection_revisions", "SELECT repository_id, revision FROM cr", R, _REVISIONS)
def _(spark, d):
    return mutations.collection_revisions(_repositories(spark, d), m.runs(spark, d))


@query("create_collections", """SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY q.repository_id, q.title, q.overview) AS id, CASE WHEN q.title = '  ' THEN '새 컬렉션' ELSE substr(trim(q.title), 1, 80) END AS title, cr.revision AS created_revision, 'a' AS tags
FROM (SELECT CAST(id AS VARCHAR) AS repository_id, CASE WHEN id % 3 = 0 THEN '  ' ELSE title END AS title, overview_markdown || id AS overview FROM k) q JOIN cr ON cr.repository_id = q.repository_id""", R, K, _REVISIONS)
def _(spark, d):
    known = m.collections(spark, d)
    asked = known.select(F.col("id").cast("string").alias("repository_id"), F.when(F.col("id") % 3 == 0, "  ").otherwise(F.col("title")).alias("title"), F.concat("overview_markdown", F.col("id").cast("string")).alias("overview_markdown"), F.array(F.lit(" a "), F.lit("")).alias("tags"))
    made = mutations.create_collections(known.withColumn("created_revision", F.lit(None).cast("string")), _repositories(spark, d), m.runs(spark, d), asked)
    return made.where("created_revision is not null").select("id", "title", "created_revision", F.array_join("tags", ",").alias("tags"))


@query("update_collections", "SELECT id, CASE WHEN id % 2 = 0 THEN 'T' || id ELSE title END AS title, CASE WHEN id % 2 = 0 THEN 'x' ELSE tags[1] END AS tags FROM k", K)
def _(spark, d):
    k = m.collections(spark, d)
    asked = k.select(F.when(F.col("id") % 2 == 0, F.col("repository_id")).otherwise("gone").alias("repository_id"), "id", F.concat(F.lit(" T"), F.col("id").cast("string")).alias("title"), "overview_markdown", F.array(F.lit("x")).alias("tags"))
    return mutations.update_collections(k, asked)[0].select("id", "title", F.array_join("tags", ",").alias("tags"))


@query("update_items", "SELECT id, CASE WHEN id % 4 = 0 THEN 'core' ELSE role END AS role, CASE WHEN id % 4 = 0 THEN ' memo ' ELSE memo END AS memo FROM i", P, I)
def _(spark, d):
    items = m.items(spark, d)
    asked = items.where("id % 4 in (0, 1)").select("repository_id", F.when(F.col("id") % 4 == 0, F.col("collection_id")).otherwise(F.lit(-1)).alias("collection_id"), "id", F.lit(" core ").alias("role"), F.lit(" memo ").alias("memo"))
    return mutations.update_items(items, asked).select("id", "role", "memo")


@query("web_update_items", "SELECT id, CASE WHEN id % 4 = 0 THEN 'core' ELSE role END AS role, CASE WHEN id % 4 IN (0, 1) THEN 'new' ELSE memo END AS memo FROM i", P, I)
def _(spark, d):
    items = m.items(spark, d)
    asked = items.where("id % 4 in (0, 1)").select("repository_id", "collection_id", "id", F.when(F.col("id") % 4 == 0, " core ").otherwise(" ").alias("role"), F.lit("new").alias("memo"))
    return mutations.web_update_items(items, asked).select("id", "role", "memo")


@query("touch_collections", "SELECT id, id % 5 = 0 AS touched FROM k", K)
def _(spark, d):
    k = m.collections(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return mutations.touch_collections(k, k.where("id % 5 = 0")).select("id", F.col("updated_at").isNotNull().alias("touched"))


@query("require_collections", "SELECT i.id FROM i JOIN k ON k.id = i.collection_id AND k.repository_id = i.repository_id", P, I, K)
def _(spark, d):
    return mutations.require_collections(m.items(spark, d), m.collections(spark, d)).select("id")


@query("require_repositories", "SELECT r.id FROM r JOIN customer ON CAST(c_custkey AS VARCHAR) = r.repository_id", R)
def _(spark, d):
    return mutations.require_repositories(m.runs(spark, d), _repositories(spark, d)).select("id")


@query("collection_membership", """SELECT DISTINCT i.collection_id, p.symbol_id FROM i JOIN p ON p.repository_id = i.repository_id
AND (p.symbol_id = i.symbol_id OR (p.fqn = i.symbol_fqn AND p.signature = i.symbol_signature AND p.relative_path = i.relative_path)) WHERE i.status = 'linked'""", P, I)
def _(spark, d):
    return mutations.linked_item_of(m.items(spark, d), m.symbols(spark, d))


@query("restored_symbols", f"""SELECT {_ID.replace('symbol_id', 'p.symbol_id')} AS request_id, coalesce(a.symbol_id, b.id) AS symbol_id FROM p LEFT JOIN p2 a ON a.repository_id = p.repository_id AND a.symbol_id = p.symbol_id
LEFT JOIN (SELECT repository_id, fqn, signature, min(symbol_id) AS id FROM p2 GROUP BY ALL) b ON b.repository_id = p.repository_id AND b.fqn = p.fqn AND b.signature = p.signature""", P, P2)
def _(spark, d):
    wanted = m.symbols(spark, d).select(_id().alias("request_id"), "repository_id", "symbol_id", "fqn", "signature")
    return mutations.restored_symbols(wanted, m.second_revision(spark, d))


@query("legacy_notes", """SELECT o.id, CASE WHEN o.id % 3 = 0 THEN coalesce(p2.fqn, 'unknown') ELSE o.symbol_fqn END AS symbol_fqn, coalesce(p2.signature, '') AS symbol_signature, '기본 분석' AS title, 'linked' AS status
FROM o LEFT JOIN p2 ON p2.symbol_id = o.symbol_id""", P, P2, O)
def _(spark, d):
    old = m.notes(spark, d).select("id", "repository_id", "symbol_id", F.when(F.col("id") % 3 != 0, F.col("symbol_fqn")).otherwise("").alias("symbol_fqn"), "body_markdown")
    return mutations.legacy_notes(old, m.second_revision(spark, d)).select("id", "symbol_fqn", "symbol_signature", "title", "status")


@query("web_relink_items", """SELECT i.id, CASE WHEN x.symbol_id IS NULL THEN 'orphan' ELSE 'linked' END AS status, coalesce(x.ast_fingerprint <> i.ast_fingerprint, false) AS is_changed
FROM i LEFT JOIN p2 x ON x.repository_id = 'repo_main' AND i.repository_id = 'repo_main' AND x.symbol_id = i.symbol_id""", P, P2, I)
def _(spark, d):
    return mutations.web_relinked(m.items(spark, d), m.second_revision(spark, d), m.REPOSITORY).select("id", "status", "is_changed")


@query("web_create_notes", f"SELECT symbol_id FROM p WHERE {_ID} % 2 = 0 AND symbol_id NOT IN (SELECT symbol_id FROM o)", P, O)
def _(spark, d):
    s, notes = m.symbols(spark, d), m.notes(spark, d)
    asked = s.where(_id() % 2 == 0).select("repository_id", "symbol_id", F.lit("web").alias("title"))
    return mutations.web_create_notes(notes, s, asked.union(asked))[0].where("title = 'web'").select("symbol_id")


@query("web_add_items", f"""SELECT k.id AS collection_id, p.symbol_id, coalesce((SELECT max(sort_order) + 1 FROM i WHERE i.collection_id = k.id), 0) + row_number() OVER (PARTITION BY k.id ORDER BY p.symbol_id) - 1 AS sort_order
FROM k JOIN p ON {_ID.replace('symbol_id', 'p.symbol_id')} < 3 WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.collection_id = k.id AND i.repository_id = p.repository_id AND i.symbol_id = p.symbol_id)""", P, I, K)
def _(spark, d):
    s = m.symbols(spark, d)
    few = s.where(_id() < 3).select("repository_id", "symbol_id", F.lit("core").alias("role"), F.lit("added").alias("memo"))  # three rows
    asked = m.collections(spark, d).select(F.col("id").alias("collection_id")).join(F.broadcast(few))
    return mutations.web_add_items(m.items(spark, d), s, asked).where("memo = 'added'").select("collection_id", "symbol_id", "sort_order")


@query("language_filter", "SELECT symbol_id FROM p WHERE language = 'php'", P)
def _(spark, d):
    return mutations.filter_language(m.symbols(spark, d), "php").select("symbol_id")


@query("collection_quick_filter", "SELECT id FROM k WHERE contains(lower(title || ' ' || tags[1]), 'tag2')", K)
def _(spark, d):
    return mutations.quick_filter(m.collections(spark, d), " TAG2 ").select("id")


# labels

@query("next_note_titles", """SELECT symbol_id, '분석 ' || (SELECT min(x) FROM (SELECT unnest(range(n + 1, 2 * n + 2)) AS x) WHERE NOT list_contains(titles, '분석 ' || x)) AS title
FROM (SELECT symbol_id, count(*) AS n, list('분석 ' || (id % 9)) AS titles FROM o GROUP BY 1)""", P, O)
def _(spark, d):
    titles = F.collect_list(F.concat(F.lit("분석 "), (F.col("id") % 9).cast("string")))
    return m.notes(spark, d).groupBy("symbol_id").agg(titles.alias("t")).select("symbol_id", labels.next_note_title(F.col("t")).alias("title"))


@query("item_labels", """SELECT i.id, coalesce(p2.fqn, i.symbol_fqn) || coalesce(p2.signature, i.symbol_signature) AS label, '기타' AS role, CASE i.id % 3 WHEN 0 THEN '진입점' WHEN 1 THEN '예외 처리' ELSE '기타' END AS other_role
FROM i LEFT JOIN p2 ON p2.repository_id = i.repository_id AND p2.symbol_id = i.symbol_id""", P, P2, I)
def _(spark, d):
    role = F.when(F.col("id") % 3 == 0, "entry").when(F.col("id") % 3 == 1, "error")
    found = lifecycle.item_details(m.items(spark, d), m.second_revision(spark, d))
    return found.select("id", labels.item_label(F.col("current_symbol"), F.col("symbol_fqn"), F.col("symbol_signature")).alias("label"), labels.role_label(F.col("role")).alias("role"), labels.role_label(role).alias("other_role"))


@query("impact_labels", "SELECT symbol_id, split_part(fqn, '.', -2) || '.' || split_part(fqn, '.', -1) AS label, CASE CAST(symbol_id AS BIGINT) % 3 WHEN 0 THEN '비교할 이전 분석이 없습니다.' WHEN 1 THEN '마지막 분석 이후 함수 변경이 없습니다.' ELSE start_line || '개 파일 · ' || end_line || '개 함수 변경 · 2개 호출자 확인 필요' END AS summary FROM p", P)
def _(spark, d):
    status = F.element_at(F.array(F.lit("noBaseline"), F.lit("unchanged"), F.lit("changed")), (_id() % 3 + 1).cast("int"))
    return m.symbols(spark, d).select("symbol_id", labels.impact_label(F.col("fqn")).alias("label"), labels.impact_summary(status, F.col("start_line"), F.col("end_line"), F.lit(2)).alias("summary"))


@query("tags_round_trip", "SELECT id, ' a |' || '|' || symbol_status AS tags FROM (SELECT id, tags[3] AS symbol_status FROM o)", P, O)
def _(spark, d):
    return m.notes(spark, d).select("id", F.array_join(labels.tags_of(labels.tags_json(F.col("tags"))), "|").alias("tags"))


@query("decoded_kinds", "SELECT language, count(*) AS symbols FROM p GROUP BY 1", P)
def _(spark, d):
    return m.symbols(spark, d).select(labels.language(F.col("language")).alias("language")).groupBy("language").agg(F.count("*").alias("symbols"))


@query("viewed_languages", "SELECT p_partkey AS id, ['python', 'php', 'typescript', 'java'][p_partkey % 4 + 1] AS language FROM part")
def _(spark, d):
    path = F.concat(F.lit("a/b"), F.element_at(F.array(*map(F.lit, (".py", ".php", ".tsx", ".md"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return m.read(spark, d, "part").select(F.col("p_partkey").alias("id"), syntax.viewed_language(path).alias("language"))


# orders: the place of each row is in the result, so the order is compared

@query("collection_order", "SELECT id, row_number() OVER (ORDER BY (id % 7) DESC, lower(title), id) AS place FROM k", K)
def _(spark, d):
    rows = m.collections(spark, d).withColumn("updated_at", F.col("id") % 7)
    return orders.placed(orders.COLLECTIONS, rows).select("id", "place")


@query("item_order", "SELECT id, row_number() OVER (ORDER BY collection_id, sort_order, id) AS place FROM i", P, I)
def _(spark, d):
    return orders.placed(orders.ITEMS, m.items(spark, d)).select("id", "place")


@query("repository_order", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_nationkey DESC, lower(c_mktsegment), c_custkey) AS place FROM customer")
def _(spark, d):
    rows = m.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("updated_at"), F.col("c_mktsegment").alias("display_name"))
    return orders.placed(orders.REPOSITORIES, rows).select("id", "place")


@query("file_order", "SELECT relative_path, row_number() OVER (ORDER BY lower(relative_path), relative_path) AS place FROM (SELECT DISTINCT relative_path FROM p2)", P, P2)
def _(spark, d):
    return orders.placed(orders.FILES, m.second_revision(spark, d).select("relative_path").distinct())


@query("relink_candidates", "SELECT symbol_id, fqn FROM p WHERE contains(lower(fqn), 'economy.red') ORDER BY fqn, symbol_id LIMIT 8", P)
def _(spark, d):
    return orders.relink_candidates(m.symbols(spark, d), None, "ECONOMY.red").select("symbol_id", "fqn")


# exports

def _sources(spark, d):
    """Thirty numbered lines for every other brand's file; the others have no source."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("x < "), i.cast("string"))), "\n")
    return m.symbols(spark, d).select("relative_path").distinct().where("relative_path not like '%2'").select("relative_path", lines.alias("source"))


_BODY = """body AS (SELECT *, CASE WHEN NOT known THEN '<p>See [line:' || x || '-' || y || '] &amp; &lt;more&gt;</p>' ELSE '<p>See </p>' || CASE
  WHEN x < 1 OR y < 1 THEN '<p>[line:' || x || '-' || y || ']</p>' WHEN least(x, y) > 30 THEN '<p><strong>[line:' || x || '-' || y || ']</strong> — 현재 소스에서 찾지 못함</p>'
  ELSE '<p><strong>' || path || ' · ' || CASE WHEN least(x, y) = least(30, greatest(x, y)) THEN CAST(least(x, y) AS VARCHAR) ELSE least(x, y) || '–' || least(30, greatest(x, y)) END || '행</strong></p><pre><code class="language-' || language || '">'
    || array_to_string(list_transform(range(least(x, y), least(30, greatest(x, y)) + 1), lambda n: 'x &lt; ' || n), chr(10)) || '</code></pre>' END || '<p> &amp; &lt;more&gt;</p>' END AS html,
  CASE WHEN known AND x >= 1 AND y >= 1 AND least(x, y) <= 30 THEN 1 ELSE 0 END AS resolved, CASE WHEN NOT known OR (x >= 1 AND y >= 1 AND least(x, y) > 30) THEN 1 ELSE 0 END AS unresolved
  FROM (SELECT o.id, o.title, o.tags, o.symbol_id, o.updated_at, o.status, p.fqn, p.signature, p.language, p.relative_path AS path, p.relative_path NOT LIKE '%2' AS known, q.o_orderkey % 50 AS x, q.o_custkey % 40 AS y FROM o JOIN p ON p.symbol_id = o.symbol_id JOIN orders q ON q.o_orderkey = o.id))"""


@query("note_exports", """SELECT id, '<h1>' || title || '</h1><p><strong>함수:</strong> <code>' || fqn || signature || '</code><br><strong>소스:</strong> ' || path || '</p>' || html || '<p><strong>태그:</strong> ' || array_to_string(tags, ', ') || '</p>' AS html,
  resolved, unresolved FROM body""", P, O, _BODY)
def _(spark, d):
    return exports.note_exports(m.notes(spark, d), m.symbols(spark, d), _sources(spark, d)).select("id", "html", "resolved", "unresolved")


@query("item_notes", "SELECT i.id AS item_id, coalesce(string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.updated_at DESC, o.id DESC), '') AS notes FROM i LEFT JOIN o ON o.repository_id = i.repository_id AND o.symbol_id = i.symbol_id AND o.status = 'linked' WHERE i.status = 'linked' GROUP BY 1", P, I, O)
def _(spark, d):
    found = exports.item_notes(m.items(spark, d), m.notes(spark, d))
    return found.select("item_id", F.array_join(F.col("notes").cast("array<string>"), ",").alias("notes"))


@query("collection_exports", """SELECT k.id, '<h1>' || replace(replace(replace(replace(replace(k.title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '</h1><p><strong>태그:</strong> ' || k.tags[1] || '</p><p>' || k.overview_markdown || '</p>'
  || coalesce(string_agg('<section><h2>' || rn || '. ' || fqn || sig || '</h2><p><strong>역할:</strong> 기타<br><strong>위치:</strong> ' || path || ':' || line || CASE WHEN changed THEN '<br><strong>상태:</strong> 분석 이후 코드 변경 확인 필요' ELSE '' END || CASE WHEN lost THEN '<br><strong>상태:</strong> 연결 필요' ELSE '' END || '</p>'
  || CASE WHEN trim(coalesce(memo, '')) <> '' THEN '<p>' || replace(replace(replace(replace(replace(replace(coalesce(memo, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), chr(10), '<br>') || '</p>' ELSE '' END || coalesce(articles, '') || '</section>', '' ORDER BY rn), '') AS html, CAST(coalesce(sum(n), 0) AS BIGINT) AS included_notes, CAST(coalesce(sum(res), 0) AS BIGINT) AS resolved, CAST(coalesce(sum(unres), 0) AS BIGINT) AS unresolved
FROM k LEFT JOIN (
  SELECT i.collection_id, row_number() OVER (PARTITION BY i.collection_id ORDER BY i.sort_order, i.id) AS rn, i.symbol_fqn AS fqn, i.symbol_signature AS sig, i.relative_path AS path, i.start_line AS line, i.memo, i.status = 'orphan' AS lost,
    coalesce(i.status = 'linked' AND p.ast_fingerprint <> i.ast_fingerprint, false) AS changed, b.articles, b.n, b.res, b.unres
  FROM i LEFT JOIN p ON p.repository_id = i.repository_id AND p.symbol_id = i.symbol_id
  LEFT JOIN (SELECT symbol_id, string_agg('<article><h3>' || title || '</h3>' || html || '<p><strong>태그:</strong> ' || array_to_string(tags, ', ') || '</p></article>', '' ORDER BY id) AS articles, count(*) AS n, sum(resolved) AS res, sum(unresolved) AS unres FROM body WHERE status = 'linked' GROUP BY 1) b ON b.symbol_id = i.symbol_id) x ON x.collection_id = k.id
GROUP BY k.id, k.title, k.tags, k.overview_markdown""", P, I, K, O, _BODY)
def _(spark, d):
    items = m.items(spark, d)
    notes = m.notes(spark, d).where("status = 'linked'").select("symbol_id", F.col("id").alias("place"), "title", "body_markdown", "tags")
    selected = items.select(F.col("id").alias("item_id"), "symbol_id").join(notes, "symbol_id").drop("symbol_id")
    return exports.collection_exports(m.collections(spark, d), items, m.symbols(spark, d), selected, _sources(spark, d)).select("id", "html", "included_notes", "resolved", "unresolved")


@query("references_at", "SELECT o_orderkey AS id, least(x, y) AS first, greatest(x, y) AS last FROM (SELECT o_orderkey, CAST(o_orderkey % 50 AS INTEGER) AS x, CAST(o_custkey % 40 AS INTEGER) AS y FROM orders WHERE o_orderkey % 2 = 0) WHERE x >= 1 AND y >= 1")
def _(spark, d):
    at = F.when(F.col("id") % 2 == 0, 4).otherwise(3)
    found = m.notes(spark, d).select("id", exports.reference_at("body_markdown", at).alias("r")).where("r.first is not null")
    return found.select("id", "r.first", "r.last")


@query("syntax_tokens", "SELECT kind, n * (SELECT count(*) FROM p) AS tokens FROM (VALUES ('keyword', 2), ('function', 1), ('number', 1), ('comment', 1), ('string', 1), ('plain', 6)) AS t(kind, n)", P)
def _(spark, d):
    s = m.symbols(spark, d).select(F.concat(F.lit("def f"), "symbol_id", F.lit("():\n    return "), F.col("start_line").cast("string"), F.lit(" + 'a'  # note")).alias("source"))
    found = s.select(F.explode(F.flatten(exports.syntax_tokens("source", F.lit("python")))).alias("t"))
    return found.groupBy("t.kind").agg(F.count("*").alias("tokens"))


# states

@query("state_items", "SELECT conv_id, turn AS id, CASE WHEN turn % 2 = 0 THEN turn * 10 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 END AS sort_order FROM conversations")
def _(spark, d):
    """Version-1 states: items with an even id have a sort order, others take their place."""
    item = F.struct(F.col("turn").alias("id"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 10).alias("sortOrder"))
    each = m.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("i"))
    texts = each.select(F.to_json(F.struct(F.lit("x.state").alias("kind"), F.lit(1).alias("version"), F.struct(F.col("i").alias("collectionItems"), F.struct(F.col("conv_id").alias("noteId")).alias("counters")).alias("data"))).alias("value"))
    found = state.parse_states(texts)
    return found.select(F.col("counters.noteId").alias("conv_id"), F.explode("collectionItems").alias("i")).select("conv_id", "i.id", F.col("i.sortOrder").alias("sort_order"))


@query("workspace_states", """SELECT c_custkey AS id, c_custkey % 4 < 3 AND c_custkey % 5 > 0 AS valid, CASE WHEN c_custkey % 4 < 3 AND c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'explore' ELSE 'record' END END AS active_workspace,
  CASE WHEN c_custkey % 4 < 3 AND c_custkey % 5 > 0 AND c_custkey % 3 > 0 THEN c_custkey END AS selected_note_id FROM customer""")
def _(spark, d):
    """Depths of 1 to 4 (4 is refused), a missing query for every fifth, an older workspace's name, a note id as text for every third."""
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"version": 1, "activeWorkspace": "'), F.when(k % 2 == 0, "find").otherwise("record"), F.lit('", "noteDrafts": [], "depth": '), (k % 4 + 1).cast("string"), F.when(k % 5 > 0, ', "query": ""').otherwise(""), F.lit(', "selectedNoteId": '), F.when(k % 3 > 0, k.cast("string")).otherwise('"7"'), F.lit("}"))
    found = m.read(spark, d, "customer").select(k.alias("id"), text.alias("state_json"))
    return found.select("id", *state.workspace_state()).select("id", "valid", "active_workspace", "selected_note_id")


# extraction: a file for each part, in its symbol's language

def _files(spark, d):
    name = F.concat(F.lit("f"), "symbol_id")
    java = F.concat(F.lit("package a;\nclass C {\n  void "), name, F.lit("(int x) { }\n  void caller() { "), name, F.lit("(1); gone(); }\n}\n"))
    php = F.concat(F.lit("<?php\nfunction "), name, F.lit("($x) { }\nfunction caller() { "), name, F.lit("(1); gone(); }\n"))
    python = F.concat(F.lit("def "), name, F.lit("(x):\n    pass\ndef caller():\n    "), name, F.lit("(1)\n    gone()\n"))
    typescript = F.concat(F.lit("function "), name, F.lit("(x) { }\nfunction caller() { "), name, F.lit("(1); gone(); }\n"))
    text = F.when(F.col("language") == "java", java).when(F.col("language") == "php", php).when(F.col("language") == "python", python).otherwise(typescript)
    return m.symbols(spark, d).select("language", F.concat(F.lit("m"), "symbol_id", F.lit("/x")).alias("relative_path"), text.alias("text"))


_FOUND = "found AS (SELECT language, CASE language WHEN 'java' THEN 'a.C' ELSE 'm' || symbol_id || '.x' END AS scope, symbol_id, CASE language WHEN 'java' THEN '(int x)' WHEN 'php' THEN '($x)' ELSE '(x)' END AS args FROM p)"


@query("extract_symbols", "SELECT scope || '.f' || symbol_id AS fqn, args AS signature FROM found UNION ALL SELECT scope || '.caller', '()' FROM found", P, _FOUND)
def _(spark, d):
    return extract(_files(spark, d), m.REPOSITORY)[0].select("fqn", "signature")


@query("extract_edges", "SELECT language, 'resolved' AS confidence, count(*) AS calls FROM p GROUP BY 1 UNION ALL SELECT language, 'unresolved', count(*) FROM p GROUP BY 1", P)
def _(spark, d):
    symbols, calls, _diagnostics = extract(_files(spark, d), m.REPOSITORY)
    return resolve.resolve_calls(symbols, calls, keep=("language",)).groupBy("language", "confidence").agg(F.count("*").alias("calls"))


@query("extract_diagnostics", "SELECT 0 AS diagnostics")
def _(spark, d):
    return extract(_files(spark, d), m.REPOSITORY)[2].agg(F.count("*").cast("int").alias("diagnostics"))


@query("collection_graph", "SELECT i.collection_id, count(*) AS edges FROM e JOIN (SELECT DISTINCT collection_id, symbol_id FROM i WHERE status = 'linked') i ON i.symbol_id = e.a JOIN (SELECT DISTINCT collection_id, symbol_id FROM i WHERE status = 'linked') j ON j.symbol_id = e.b AND j.collection_id = i.collection_id GROUP BY 1", *CALLS_AND_EDGES, I)
def _(spark, d):
    linked = m.items(spark, d).where("status = 'linked'").select("collection_id", F.col("symbol_id").alias("node"))
    return graph.induced_subgraph(m.call_edges(spark, d), linked, ["collection_id"]).groupBy("collection_id").agg(F.count("*").alias("edges"))


@query("note_by_id", "SELECT id, symbol_id FROM o WHERE id = 7", P, O)
def _(spark, d):
    return lifecycle.lookup(m.notes(spark, d), id=7).select("id", "symbol_id")


@query("repository_by_path", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS root_path FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def _(spark, d):
    rows = m.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("root_path"))
    return lifecycle.lookup(rows, root_path=rows.agg(F.min("root_path")).first()[0])


@query("snapshot_by_id", "SELECT event_id AS snapshot_id, CAST(user_id AS VARCHAR) AS repository_id FROM events WHERE event_id = 11")
def _(spark, d):
    log = m.read(spark, d, "events").select(F.col("event_id").alias("snapshot_id"), F.col("user_id").cast("string").alias("repository_id"))
    return lifecycle.lookup(log, snapshot_id=11)


@query("symbol_by_id", "SELECT symbol_id, fqn FROM p WHERE repository_id = 'repo_main' AND symbol_id = '1'", P)
def _(spark, d):
    return lifecycle.lookup(m.symbols(spark, d), repository_id=m.REPOSITORY, symbol_id="1").select("symbol_id", "fqn")


@query("item_by_id", "SELECT id, collection_id FROM i WHERE collection_id = 1 AND id = 1000", P, I)
def _(spark, d):
    return lifecycle.lookup(m.items(spark, d), collection_id=1, id=1000).select("id", "collection_id")
