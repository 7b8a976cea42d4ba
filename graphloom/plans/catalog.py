"""All registered queries over the model, and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, names
from ..operators import graph, impact, lifecycle, resolve, search
from . import projections as m

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROOT = "0"


def query(name: str, sql: str | None = None, *parts: str):
    """Register a function as a query; parts are the projections that its SQL stands on."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql
        return f

    return add


def _main(table: DataFrame) -> DataFrame:
    return lifecycle.within(m.REPOSITORY, table)[0]


P, N, C, RS, E, P2, I, K, O, R = m.SYMBOLS, m.NEXT, m.CALLS, m.RESOLVED, m.EDGES, m.SECOND, m.ITEMS, m.COLLECTIONS, m.NOTES, m.RUNS
#: The projections that the edges of all calls stand on.
CALLS_AND_EDGES = (P, N, C, RS, E)


@query("symbols_browse", "SELECT symbol_id, language, fqn, signature, relative_path FROM p WHERE repository_id = 'repo_main'", P)
def _(spark, d):
    return search.browse(_main(m.symbols(spark, d))).select("symbol_id", "language", "fqn", "signature", "relative_path")


@query("symbols_by_ids", "SELECT symbol_id, fqn FROM p WHERE symbol_id IN (SELECT DISTINCT b FROM e)", P, N, C, RS, E)
def _(spark, d):
    return m.symbols(spark, d).join(m.call_edges(spark, d).select(F.col("callee_symbol_id").alias("symbol_id")), "symbol_id", "left_semi").select("symbol_id", "fqn")


BM25 = """t AS (SELECT symbol_id, fqn, list_filter(regexp_split_to_array(lower(fqn || ' ' || signature || ' ' || relative_path), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM p WHERE repository_id = 'repo_main'),
f AS (SELECT symbol_id, fqn, len(ts) AS n, len(list_filter(ts, lambda x: starts_with(x, 'brand1'))) AS t0,
  len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'red' AND starts_with(ts[i + 1], 'w'))) AS t1 FROM t),
s AS (SELECT count(*) AS n, avg(n) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM f)"""


SCORES = """SELECT symbol_id, fqn, round(ln(1 + (s.n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.n / a))
  + ln(1 + (s.n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.n / a)), 6) AS score
FROM f, s WHERE t0 > 0 AND t1 > 0 ORDER BY score DESC, fqn, symbol_id LIMIT 80"""


@query("symbols_search_prefix", SCORES, P, BM25)
def _(spark, d):
    return search.search(_main(m.symbols(spark, d)), "Brand1 red_w")


@query("symbols_search_substring", "SELECT symbol_id, fqn FROM p WHERE contains(lower(fqn || ' ' || signature || ' ' || relative_path || ' ' || kind || ' ' || language), 'promo.red') AND repository_id = 'repo_main' ORDER BY fqn, symbol_id LIMIT 100", P)
def _(spark, d):
    return search.search_substring(_main(m.symbols(spark, d)), "PROMO.red").select("symbol_id", "fqn")


def _resolved(spark, d, **options):
    return resolve.resolve_calls(m.symbols(spark, d), m.raw_calls(spark, d), keep=("l_orderkey", "rn", "language"), **options)


@query("resolve_calls", "SELECT l_orderkey, rn, caller_symbol_id, CASE WHEN confidence = 'resolved' THEN id END AS callee_symbol_id, confidence, source_line FROM w", P, N, C, RS)
def _(spark, d):
    return _resolved(spark, d).select("l_orderkey", F.col("rn").cast("bigint").alias("rn"), "caller_symbol_id", "callee_symbol_id", "confidence", "source_line")


@query("resolve_summary", "SELECT language, confidence, count(*) AS calls FROM w GROUP BY ALL", P, N, C, RS)
def _(spark, d):
    return _resolved(spark, d).groupBy("language", "confidence").agg(F.count("*").alias("calls"))


@query("resolve_calls_web", "SELECT language, CASE web WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS confidence, count(*) AS calls FROM v GROUP BY ALL", P, N, C, RS)
def _(spark, d):
    return _resolved(spark, d, web=True).groupBy("language", "confidence").agg(F.count("*").alias("calls"))


@query("uncertain_edges", "SELECT edge_id, unresolved_name, source_line FROM e WHERE b IS NULL", P, N, C, RS, E)
def _(spark, d):
    return m.call_edges(spark, d).where("callee_symbol_id is null").select("edge_id", "unresolved_name", "source_line")


@query("confirmed_edge_count", "SELECT count(b) AS confirmed, count(*) - count(b) AS uncertain FROM e", P, N, C, RS, E)
def _(spark, d):
    known = F.col("callee_symbol_id").isNotNull()
    return m.call_edges(spark, d).agg(F.count_if(known).alias("confirmed"), F.count_if(~known).alias("uncertain"))


_REACH = """l AS (SELECT a AS x, b AS y FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
walk(node, dist) AS (SELECT symbol_id, 0 FROM p WHERE symbol_id = '0' UNION SELECT l.y, walk.dist + 1 FROM walk JOIN l ON l.x = walk.node WHERE walk.dist < {depth}),
near AS (SELECT node, min(dist) AS distance FROM walk GROUP BY node)"""

for _depth in (1, 2, 3):

    @query(f"graph_neighbourhood_d{_depth}", "SELECT p.symbol_id, p.fqn, near.distance FROM near JOIN p ON p.symbol_id = near.node", P, N, C, RS, E, _REACH.format(depth=_depth))
    def _(spark, d, depth=_depth):
        nodes, _edges = graph.neighbourhood(m.symbols(spark, d), m.call_edges(spark, d), ROOT, depth)
        return nodes.select("symbol_id", "fqn", "distance")


@query("graph_edges_d2", "SELECT DISTINCT edge_id, a AS caller_symbol_id, b AS callee_symbol_id, unresolved_name FROM e JOIN near ON near.distance < 2 AND (near.node = e.a OR near.node = e.b)", P, N, C, RS, E, _REACH.format(depth=2))
def _(spark, d):
    return graph.neighbourhood(m.symbols(spark, d), m.call_edges(spark, d), ROOT, 2)[1].select("edge_id", "caller_symbol_id", "callee_symbol_id", "unresolved_name")


@query("graph_discovered_d2", "SELECT DISTINCT edge_id FROM e JOIN near ON near.distance < 2 AND (near.node = e.a OR near.node = e.b) WHERE a IN (SELECT node FROM near) AND b IN (SELECT node FROM near)", P, N, C, RS, E, _REACH.format(depth=2))
def _(spark, d):
    return graph.discovered_graph(m.symbols(spark, d), m.call_edges(spark, d), ROOT, 2)[1].select("edge_id")


@query("induced_subgraph", "SELECT i.collection_id, e.edge_id, e.a, e.b FROM e JOIN (SELECT DISTINCT collection_id, symbol_id FROM i WHERE status = 'linked') i ON i.symbol_id = e.a JOIN (SELECT DISTINCT collection_id, symbol_id FROM i WHERE status = 'linked') j ON j.symbol_id = e.b AND j.collection_id = i.collection_id", P, N, C, RS, E, I)
def _(spark, d):
    linked = m.items(spark, d).where("status = 'linked'").select("collection_id", F.col("symbol_id").alias("node"))
    return graph.induced_subgraph(m.call_edges(spark, d), linked, ["collection_id"]).select("collection_id", "edge_id", F.col("caller_symbol_id").alias("a"), F.col("callee_symbol_id").alias("b"))


_DIFF = """k1 AS (SELECT repository_id, language, fqn, signature, max((relative_path, symbol_id, ast_fingerprint)) AS s FROM p GROUP BY ALL), k2 AS (SELECT repository_id, language, fqn, signature, max((relative_path, symbol_id, ast_fingerprint)) AS s FROM p2 GROUP BY ALL),
ch AS (SELECT repository_id, language, fqn, signature, k1.s[2] AS base_id, k2.s[2] AS current_id, k1.s[1] AS base_path, k2.s[1] AS current_path,
  CASE WHEN k1.s IS NULL THEN 'added' WHEN k2.s IS NULL THEN 'deleted' WHEN k1.s[1] <> k2.s[1] THEN 'moved' WHEN k1.s[3] <> k2.s[3] THEN 'modified' END AS kind FROM k1 FULL JOIN k2 USING (repository_id, language, fqn, signature))"""


@query("symbol_diff", "SELECT repository_id, language, fqn, signature, kind, base_id, current_id, base_path, current_path FROM ch WHERE kind IS NOT NULL", P, P2, _DIFF)
def _(spark, d):
    return impact.diff_symbols(m.symbols(spark, d), m.second_revision(spark, d))


_FILES = "f1 AS (SELECT repository_id, relative_path, md5(string_agg(ast_fingerprint, '' ORDER BY ast_fingerprint)) AS h FROM p GROUP BY 1, 2), f2 AS (SELECT repository_id, relative_path, md5(string_agg(ast_fingerprint, '' ORDER BY ast_fingerprint)) AS h FROM p2 GROUP BY 1, 2)"


def _files(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repository_id", "relative_path").agg(F.md5(F.array_join(F.array_sort(F.collect_list("ast_fingerprint")), "")).alias("content_fingerprint"))


@query("file_diff", "SELECT repository_id, relative_path FROM f1 FULL JOIN f2 USING (repository_id, relative_path) WHERE f1.h IS DISTINCT FROM f2.h", P, P2, _FILES)
def _(spark, d):
    return impact.diff_files(_files(m.symbols(spark, d)), _files(m.second_revision(spark, d)))


@query("impact_status", """SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE repository_id = '1' AND status IN ('completed', 'partial') AND completed_at IS NOT NULL) THEN 'noBaseline' WHEN changed_files > 0 OR changes > 0 THEN 'changed' ELSE 'unchanged' END AS status, changed_files, changes
FROM (SELECT (SELECT count(*) FROM f1 FULL JOIN f2 USING (repository_id, relative_path) WHERE f1.h IS DISTINCT FROM f2.h) AS changed_files, (SELECT count(*) FROM ch WHERE kind IS NOT NULL) AS changes)""", P, P2, R, _FILES, _DIFF)
def _(spark, d):
    a, b = m.symbols(spark, d), m.second_revision(spark, d)
    known = bool(impact.latest_run(m.runs(spark, d)).where("repository_id = '1'").take(1))
    return impact.impact_status(known, impact.diff_files(_files(a), _files(b)), impact.diff_symbols(a, b))


_CALLERS = """el AS (SELECT DISTINCT a, b FROM e WHERE b IS NOT NULL), seeds AS (SELECT base_id AS seed, true AS gone FROM ch WHERE kind = 'deleted' UNION SELECT current_id, false FROM ch WHERE kind <> 'deleted'),
back(seed, gone, node, dist) AS (SELECT seed, gone, seed, 0 FROM seeds UNION SELECT back.seed, back.gone, el.a, dist + 1 FROM back JOIN el ON el.b = back.node WHERE dist < 3),
hit AS (SELECT seed, gone, node, min(dist) AS dist FROM back GROUP BY ALL HAVING min(dist) > 0),
nm AS (SELECT hit.*, q.repository_id, q.language, q.fqn, q.signature, q.relative_path, q.ast_fingerprint FROM hit JOIN (SELECT true AS g, * FROM p UNION ALL SELECT false, * FROM p2) q ON q.g = hit.gone AND q.symbol_id = hit.node)"""


@query("impacted_callers", """SELECT nm.repository_id, k2.s[2] AS symbol_id, nm.fqn, nm.relative_path, min(dist) AS distance, array_to_string(list_sort(list_distinct(list(seed))), ',') AS seeds
FROM nm JOIN k2 ON k2.repository_id = nm.repository_id AND k2.language = nm.language AND k2.fqn = nm.fqn AND k2.signature = nm.signature AND k2.s[1] = nm.relative_path AND k2.s[3] = nm.ast_fingerprint
WHERE NOT EXISTS (SELECT 1 FROM ch WHERE kind IS NOT NULL AND ch.repository_id = nm.repository_id AND ch.language = nm.language AND ch.fqn = nm.fqn AND ch.signature = nm.signature) GROUP BY 1, 2, 3, 4""", P, P2, _DIFF, N, C, RS, E, _CALLERS)
def _(spark, d):
    a, b, e = m.symbols(spark, d), m.second_revision(spark, d), m.call_edges(spark, d)
    found = impact.affected_callers(impact.diff_symbols(a, b), a, e, b, e)
    return found.withColumn("seeds", F.array_join("seeds", ","))


@query("collection_summary", """SELECT k.id, k.title, count(i.id) AS item_count, count(*) FILTER (i.status = 'orphan') AS orphan_count, count(*) FILTER (i.status = 'linked' AND p.ast_fingerprint <> i.ast_fingerprint) AS changed_count
FROM k LEFT JOIN i ON i.collection_id = k.id LEFT JOIN p ON p.repository_id = i.repository_id AND p.symbol_id = i.symbol_id GROUP BY k.id, k.title""", P, I, K)
def _(spark, d):
    return lifecycle.collection_summaries(m.collections(spark, d), m.items(spark, d), m.symbols(spark, d)).select("id", "title", "item_count", "orphan_count", "changed_count")


@query("collection_items", "SELECT i.id, i.sort_order, p.fqn AS current_fqn, coalesce(i.status = 'linked' AND p.ast_fingerprint <> i.ast_fingerprint, false) AS is_changed FROM i LEFT JOIN p ON p.symbol_id = i.symbol_id", P, I)
def _(spark, d):
    return lifecycle.item_details(m.items(spark, d), m.symbols(spark, d)).select("id", "sort_order", F.col("current_symbol.fqn").alias("current_fqn"), "is_changed")


@query("collection_search", "SELECT id FROM k WHERE contains(lower(title), 'promo') OR contains(lower(overview_markdown), 'promo') OR contains(tags[1], 'promo') OR id IN (SELECT collection_id FROM i WHERE contains(lower(symbol_fqn), 'promo') OR contains(lower(memo), 'promo') OR contains(lower(relative_path), 'promo') OR contains(lower(role), 'promo'))", P, I, K)
def _(spark, d):
    return lifecycle.search_collections(m.collections(spark, d), m.items(spark, d), "Promo").select("id")


@query("relink_notes", "SELECT o.id, coalesce(q.id, o.symbol_id) AS symbol_id, CASE WHEN q.id IS NOT NULL OR o.symbol_id IN (SELECT symbol_id FROM p2) THEN 'linked' ELSE 'orphan' END AS status FROM o LEFT JOIN (SELECT repository_id, fqn, signature, min(symbol_id) AS id FROM p2 GROUP BY ALL) q ON q.repository_id = o.repository_id AND q.fqn = o.symbol_fqn AND q.signature = o.symbol_signature", P, P2, O)
def _(spark, d):
    return lifecycle.relink_notes(m.notes(spark, d), m.second_revision(spark, d)).select("id", "symbol_id", "status")


@query("relink_items", """SELECT id, symbol_id, 'linked' AS status FROM i WHERE status = 'linked' AND symbol_id IN (SELECT symbol_id FROM p2)
UNION ALL SELECT id, CASE WHEN won THEN target END, CASE WHEN won THEN 'linked' ELSE 'orphan' END FROM (
  SELECT *, target IS NOT NULL AND NOT taken AND row_number() OVER (PARTITION BY collection_id, target ORDER BY id) = 1 AS won FROM (
    SELECT i.id, i.collection_id, coalesce(x.id, y.id) AS target, EXISTS (SELECT 1 FROM i j WHERE j.collection_id = i.collection_id AND j.status = 'linked' AND j.symbol_id = coalesce(x.id, y.id) AND j.symbol_id IN (SELECT symbol_id FROM p2)) AS taken
    FROM i LEFT JOIN (SELECT repository_id, fqn, signature, min(symbol_id) AS id FROM p2 GROUP BY ALL HAVING count(*) = 1) x ON x.repository_id = i.repository_id AND x.fqn = i.symbol_fqn AND x.signature = i.symbol_signature
    LEFT JOIN (SELECT repository_id, ast_fingerprint, min(symbol_id) AS id FROM p2 GROUP BY ALL HAVING count(*) = 1) y ON y.repository_id = i.repository_id AND y.ast_fingerprint = i.ast_fingerprint
    WHERE NOT (i.status = 'linked' AND i.symbol_id IN (SELECT symbol_id FROM p2))))""", P, P2, I)
def _(spark, d):
    return lifecycle.relink_items(m.items(spark, d), m.second_revision(spark, d)).select("id", "symbol_id", "status")


@query("unique_symbol_match", "SELECT repository_id, fqn, signature, min(symbol_id) AS symbol_id FROM p GROUP BY repository_id, fqn, signature HAVING count(*) = 1", P)
def _(spark, d):
    return lifecycle.unique_match(m.symbols(spark, d), ["fqn", "signature"])


@query("compact_order", "SELECT id, row_number() OVER (PARTITION BY collection_id ORDER BY sort_order, id) - 1 AS sort_order FROM i", P, I)
def _(spark, d):
    return lifecycle.compact_order(m.items(spark, d)).select("id", "sort_order")


@query("reorder_items", "SELECT id, CASE WHEN collection_id % 2 = 0 THEN row_number() OVER (PARTITION BY collection_id ORDER BY id DESC) - 1 ELSE sort_order END AS sort_order, collection_id % 2 = 0 AS valid FROM i", P, I)
def _(spark, d):
    items = m.items(spark, d)
    asked = items.groupBy("collection_id").agg(F.reverse(F.array_sort(F.collect_list("id"))).alias("ids"))
    asked = asked.withColumn("ids", F.when(F.col("collection_id") % 2 == 0, F.col("ids")).otherwise(F.concat("ids", F.slice("ids", 1, 1))))
    return lifecycle.reorder_items(items, asked).select("id", "sort_order", "valid")


@query("next_ordinal", "SELECT collection_id, max(sort_order) + 1 AS next_order FROM i GROUP BY 1", P, I)
def _(spark, d):
    return lifecycle.next_ordinal(m.items(spark, d))


@query("latest_run", "SELECT repository_id, id, revision FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY id DESC) AS rn FROM r WHERE status IN ('completed', 'partial') AND completed_at IS NOT NULL) WHERE rn = 1", R)
def _(spark, d):
    return impact.latest_run(m.runs(spark, d)).select("repository_id", "id", "revision")


@query("revision_check", "SELECT repository_id, coalesce(arg_max(revision, id) FILTER (status IN ('completed', 'partial') AND completed_at IS NOT NULL) = 'rev5', false) AS analysed FROM r GROUP BY 1", R)
def _(spark, d):
    done = F.col("status").isin("completed", "partial") & F.col("completed_at").isNotNull()
    return m.runs(spark, d).groupBy("repository_id").agg(F.coalesce(F.max_by(F.when(done, F.col("revision")), F.when(done, F.col("id"))) == "rev5", F.lit(False)).alias("analysed"))


@query("snapshot_promotion", "SELECT snapshot_id, repository_id, CASE WHEN rn = 1 THEN 'current' ELSE 'previous_valid' END AS status FROM (SELECT event_id AS snapshot_id, CAST(user_id AS VARCHAR) AS repository_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn <= 2")
def _(spark, d):
    log = m.read(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("snapshot_id"), F.col("user_id").cast("string").alias("repository_id"))
    return lifecycle.snapshot_statuses(log)


@query("upsert_repository", "SELECT CASE WHEN c.c_custkey % 3 <> 0 THEN 'old' || c.c_custkey ELSE 'new' || c.c_custkey END AS id, c.c_name AS root_path, CASE WHEN c.c_custkey % 2 = 0 THEN 'h2' ELSE 'h1' END AS head FROM customer c WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def _(spark, d):
    c = m.read(spark, d, "customer").withColumn("created_at", F.lit("2020-01-01"))
    row = lambda p, h: [F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("root_path"), F.lit(h).alias("head"), "created_at"]
    return lifecycle.upsert_repositories(c.where("c_custkey % 3 <> 0").select(*row("old", "h1")), c.where("c_custkey % 2 = 0").select(*row("new", "h2"))).select("id", "root_path", "head")


@query("owner_groups", "SELECT repository_id, language, relative_path, regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) AS owner, string_agg(symbol_id, ',' ORDER BY start_line, symbol_id) AS members FROM p GROUP BY ALL", P)
def _(spark, d):
    return lifecycle.owner_groups(m.symbols(spark, d)).withColumn("members", F.array_join("members", ","))


@query("newest_note", "SELECT id, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY updated_at DESC, id DESC) AS rn FROM o WHERE status = 'linked') WHERE rn = 1", P, O)
def _(spark, d):
    return lifecycle.newest_note(m.notes(spark, d)).select("id", "symbol_id")


@query("draft_overlay", "SELECT id, CASE WHEN id % 4 = 0 THEN 'draft ' || id ELSE title END AS title FROM o", P, O)
def _(spark, d):
    notes = m.notes(spark, d)
    drafts = notes.where("id % 4 = 0 or id % 4 = 1").select("id", F.when(F.col("id") % 4 == 0, F.col("symbol_id")).otherwise("other").alias("symbol_id"), F.concat(F.lit("draft "), F.col("id").cast("string")).alias("title"), "body_markdown", "tags")
    return lifecycle.overlay_drafts(notes, drafts).select("id", "title")


@query("orphan_notes", "SELECT id, symbol_fqn, updated_at FROM o WHERE status = 'orphan'", P, O)
def _(spark, d):
    return m.notes(spark, d).where("status = 'orphan'").select("id", "symbol_fqn", "updated_at").orderBy(F.desc("updated_at"), F.desc("id"))


@query("line_references", "SELECT id, least(a, b) AS first, greatest(a, b) AS last FROM (SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS INTEGER) AS a, CAST(o_custkey % 40 AS INTEGER) AS b FROM orders) WHERE a >= 1 AND b >= 1")
def _(spark, d):
    found = m.notes(spark, d).select("id", names.line_reference(F.col("body_markdown")).alias("r")).where("r is not null")
    return found.select("id", "r.first", "r.last")


@query("tag_cleaning", "SELECT o_orderkey AS id, 'a,' || o_orderstatus AS tags FROM orders")
def _(spark, d):
    return m.notes(spark, d).select("id", F.array_join(names.clean_tags(F.col("tags")), ",").alias("tags"))


@query("title_cleaning", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Untitled' ELSE substr('Note on ' || o_orderpriority, 1, 80) END AS title FROM orders")
def _(spark, d):
    blank = F.when(F.col("id") % 5 == 0, "   ").otherwise(F.col("title"))
    return m.notes(spark, d).select("id", names.clean_title(blank, "Untitled").alias("title"))


@query("html_escape", "SELECT o_orderkey AS id, 'See [line:' || (o_orderkey % 50) || '-' || (o_custkey % 40) || '] &amp; &lt;more&gt;' AS html FROM orders")
def _(spark, d):
    return m.notes(spark, d).select("id", names.escape_html(F.col("body_markdown")).alias("html"))


@query("symbol_presentation", "SELECT symbol_id, split_part(fqn, '.', -1) AS method, split_part(fqn, '.', -2) AS owner FROM p", P)
def _(spark, d):
    return m.symbols(spark, d).select("symbol_id", names.present(F.col("fqn")).alias("x")).select("symbol_id", "x.method", "x.owner")


#: FNV-1a in SQL over the hex digits of a text's bytes; x, start, prime and modulus are filled in.
_FNV = """list_reduce(list_concat([{start}::HUGEINT], list_transform(range(0, length(hex(encode({x}))) // 2), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i + 1, 2) AS HUGEINT))), lambda h, b: (xor(h, b) * {prime}) % {modulus})"""
_FNV64 = {"start": 14695981039346656037, "prime": 1099511628211, "modulus": 1 << 64}
_FNV32 = {"start": 2166136261, "prime": 16777619, "modulus": 1 << 32}


@query("symbol_ids", f"""SELECT symbol_id, 'symbol_' || lpad(lower(to_hex({_FNV.format(x="language || ':' || relative_path || ':' || fqn || ':' || signature", **_FNV64)})), 16, '0') AS stable_id,
  lpad(lower(to_hex({_FNV.format(x="fqn", **_FNV32)})), 8, '0') AS web_hash FROM p""", P)
def _(spark, d):
    """64-bit and 32-bit FNV-1a ids of every symbol; the 32-bit one goes by UTF-16 units, bytes in these ASCII names."""
    s = m.symbols(spark, d)
    return s.select("symbol_id", hashing.symbol_id(F.col("language"), F.col("relative_path"), F.col("fqn"), F.col("signature")).alias("stable_id"), hashing.fnv32(F.col("fqn")).alias("web_hash"))


@query("restoration_flags", """SELECT id AS request_id, 'valid' AS repository, CASE WHEN id % 2 = 0 THEN 'valid' ELSE 'reconfirmation_required' END AS git_revision, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'valid' ELSE 'reconfirmation_required' END AS analysis,
  CASE WHEN id % 2 = 0 AND id % 3 = 0 AND id % 5 <> 0 THEN 'valid' ELSE 'reconfirmation_required' END AS symbol, CASE WHEN id % 2 = 0 AND id % 3 = 0 AND id % 5 <> 0 THEN 'valid' ELSE 'reconfirmation_required' END AS file,
  CASE WHEN id % 2 = 0 AND id % 3 = 0 AND id % 5 <> 0 THEN 'valid' ELSE 'reconfirmation_required' END AS lines FROM (SELECT CAST(symbol_id AS BIGINT) AS id FROM p WHERE repository_id = 'repo_main')""", P)
def _(spark, d):
    s = _main(m.symbols(spark, d)).withColumn("i", F.col("symbol_id").cast("bigint"))
    repo = spark.createDataFrame([(m.REPOSITORY, "/r", "main", "h1", False)], "id string, root_path string, branch string, head string, is_dirty boolean")
    runs = spark.createDataFrame([(1, m.REPOSITORY, "r0", "completed", "x"), (2, m.REPOSITORY, "r1", "partial", "x"), (3, m.REPOSITORY, "r2", "failed", "x")], "id bigint, repository_id string, revision string, status string, completed_at string")
    asked = s.select(F.col("i").alias("request_id"), "repository_id", F.lit("/r").alias("root_path"), F.lit("main").alias("branch"), F.when(F.col("i") % 2 == 0, "h1").otherwise("h0").alias("head"), F.when(F.col("i") % 3 == 0, "r1").otherwise("r0").alias("revision"), "symbol_id", "fqn", "signature", "relative_path", F.when(F.col("i") % 5 == 0, F.lit(-1)).otherwise(F.col("start_line")).alias("start_line"), "end_line")
    return lifecycle.restoration_flags(asked, repo, runs, s)
