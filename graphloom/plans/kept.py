"""Registered queries over a store: the kept search index, published analyses, merges and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, resolve
from ..schemas import TABLES
from ..sources.staged import new_folder, staged
from ..sources.state import redacted_states
from ..sources.store import State, Store
from . import projections as m
from .catalog import _REACH, BM25, CALLS_AND_EDGES, ROOT, SCORES, SQL, query

P, P2, I, K, O = m.SYMBOLS, m.SECOND, m.ITEMS, m.COLLECTIONS, m.NOTES
TERMS = "Brand1 red_w"


def _store(spark: SparkSession, **tables: DataFrame) -> Store:
    store = Store(spark, new_folder(spark, "store"))
    for name, rows in tables.items():
        store.create(name, rows)
    return store


def _publish(store: Store, symbols: DataFrame, revision: str, repositories=(m.REPOSITORY, m.OTHER)) -> State:
    for name in repositories:
        state = store.publish(name, revision, {"symbols": symbols.where(F.col("repository_id") == name)})
    return state


@query("kept_index_search", SCORES, P, BM25)
def _(spark, d):
    return _publish(_store(spark), m.symbols(spark, d), "1").search(m.REPOSITORY, TERMS)


@query("kept_index_after_edit", SCORES, P, P2, BM25.replace("FROM p ", "FROM p2 "))
def _(spark, d):
    """The second analysis adds a segment; postings of symbols that it dropped or changed no longer count."""
    store = _store(spark)
    _publish(store, m.symbols(spark, d), "1", [m.REPOSITORY])
    return _publish(store, m.second_revision(spark, d), "2", [m.REPOSITORY]).search(m.REPOSITORY, TERMS)


SQL["published_notes"], SQL["published_items"] = SQL["relink_notes"], SQL["relink_items"]


@query("published_notes")
def _(spark, d):
    """Notes as the commits that publish an analysis of either repository leave them."""
    return _publish(_store(spark, notes=m.notes(spark, d)), m.second_revision(spark, d), "2").table("notes").select("id", "symbol_id", "status")


@query("published_items")
def _(spark, d):
    return _publish(_store(spark, collection_items=m.items(spark, d)), m.second_revision(spark, d), "2").table("collection_items").select("id", "symbol_id", "status")


@query("published_runs", """SELECT id, repository_id, revision, 'completed' AS status, (SELECT count(*) FROM p WHERE p.repository_id = t.repository_id) AS symbols
FROM (VALUES (1, 'repo_main', '1'), (2, 'repo_other', '1'), (3, 'repo_main', '2')) AS t(id, repository_id, revision)""", P)
def _(spark, d):
    """Three analyses; the last leaves the other repository's tables alone."""
    store = _store(spark)
    _publish(store, m.symbols(spark, d), "1")
    state = _publish(store, m.symbols(spark, d), "2", [m.REPOSITORY])
    n = state.table("symbols").groupBy("repository_id").agg(F.count("*").alias("symbols"))
    return state.table("analysis_runs").join(n, "repository_id").select("id", "repository_id", "revision", "status", "symbols")


@query("merged_notes", """SELECT id, symbol_id, CASE WHEN id % 6 = 0 THEN 'Title ' || id ELSE title END AS title, CASE WHEN id % 6 = 0 THEN 'linked' ELSE status END AS status FROM o
UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY repository_id, symbol_id), symbol_id, 'New', 'linked' FROM p WHERE CAST(symbol_id AS BIGINT) % 10 = 0""", P, O)
def _(spark, d):
    """Notes changed and then created, each as a commit that writes the touched ranges of ids."""
    notes, s = m.notes(spark, d), m.symbols(spark, d)
    store = _store(spark, notes=notes)
    store.create("symbols", s, "repository_id")
    asked = notes.where("id % 6 = 0").select("repository_id", "symbol_id", "id", F.concat(F.lit("Title "), F.col("id").cast("string")).alias("title"), F.lit("body").alias("body_markdown"), "tags")
    store.update_notes(asked)
    state = store.create_notes(s.where(F.col("symbol_id").cast("bigint") % 10 == 0).select("repository_id", "symbol_id", F.lit("New").alias("title")))
    return state.table("notes").select("id", "symbol_id", "title", "status")


@query("added_items", """SELECT (SELECT max(id) FROM i) + row_number() OVER (ORDER BY k.id, p.fqn, p.signature, p.relative_path) AS id, k.id AS collection_id, p.symbol_id,
  coalesce((SELECT max(sort_order) + 1 FROM i WHERE i.collection_id = k.id), 0) + row_number() OVER (PARTITION BY k.id ORDER BY p.fqn, p.signature, p.relative_path) - 1 AS sort_order
FROM k JOIN p ON CAST(p.symbol_id AS BIGINT) < 3
WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.collection_id = k.id AND i.symbol_fqn = p.fqn AND i.symbol_signature = p.signature AND i.relative_path = p.relative_path)""", P, I, K)
def _(spark, d):
    """Three symbols added to every collection that lacks them, and the collections touched, in one commit."""
    items, s = m.items(spark, d), m.symbols(spark, d)
    collections = m.collections(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp"))
    store = _store(spark, collection_items=items, collections=collections)
    few = s.where(F.col("symbol_id").cast("bigint") < 3).select("repository_id", "symbol_id", F.col("fqn").alias("symbol_fqn"), F.col("signature").alias("symbol_signature"), "relative_path")  # three rows
    new = collections.select(F.col("id").alias("collection_id")).join(F.broadcast(few)).withColumn("status", F.lit("linked"))
    state = store.add_items(new)
    return state.table("collection_items").join(items.select("id"), "id", "left_anti").select("id", "collection_id", "symbol_id", "sort_order")


@query("promoted_snapshots", """WITH q AS (SELECT CAST(user_id AS VARCHAR) AS repository_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT repository_id, '{"at":' || event_id || '}' AS state_json, CASE WHEN r = 1 THEN 'current' ELSE 'previous_valid' END AS status FROM q WHERE r <= 2""")
def _(spark, d):
    """Snapshots saved in two commits: the first half of the events, then the rest."""
    events = m.read(spark, d, "events")
    repositories = events.select(F.col("user_id").cast("string").alias("id")).distinct()
    store = Store(spark, new_folder(spark, "store"))
    store.create("repositories", repositories, "''")
    asked = events.select(F.col("user_id").cast("string").alias("repository_id"), F.lit(1).alias("schema_version"), F.lit("v").alias("app_version"), F.lit(1).alias("database_format_version"), F.concat(F.lit('{"at":'), F.col("event_id").cast("string"), F.lit("}")).alias("state_json"), F.col("event_id").alias("place"))
    half = events.agg(F.floor(F.max("event_id") / 2)).first()[0]
    store.save_snapshots(asked.where(F.col("place") <= half))
    state = store.save_snapshots(asked.where(F.col("place") > half))
    return state.table("workspace_snapshots").select("repository_id", "state_json", "status")


_FOUND = f"""l AS (SELECT a, b, edge_id FROM e WHERE b IS NOT NULL UNION ALL SELECT b, a, edge_id FROM e WHERE b IS NOT NULL),
l1 AS (SELECT b AS node, min(edge_id) AS k1 FROM l WHERE a = '{ROOT}' AND b <> '{ROOT}' GROUP BY b),
l2 AS (SELECT l.b AS node, min((k1, edge_id)) AS k FROM l1 JOIN l ON l.a = l1.node WHERE l.b <> '{ROOT}' AND l.b NOT IN (SELECT node FROM l1) GROUP BY l.b),
found AS (SELECT '{ROOT}' AS node, 0 AS distance, 0 AS x, 0 AS y UNION ALL SELECT node, 1, k1, 0 FROM l1 UNION ALL SELECT node, 2, k[1], k[2] FROM l2)"""


@query("graph_discovery_order", "SELECT node AS symbol_id, distance, row_number() OVER (ORDER BY distance, x, y) AS place FROM found WHERE node IN (SELECT symbol_id FROM p)", *CALLS_AND_EDGES, _FOUND)
def _(spark, d):
    return graph.discovery_order(m.symbols(spark, d), m.call_edges(spark, d), ROOT, 2)


_NEAR = _REACH.format(depth=2).replace(f"symbol_id = '{ROOT}'", f"symbol_id = '{ROOT}' AND repository_id = '{m.REPOSITORY}'")


def _graph(spark, d):
    """Both repositories published with their edges."""
    store, s, e = _store(spark), m.symbols(spark, d), staged(m.call_edges(spark, d), "edges")
    for name in (m.REPOSITORY, m.OTHER):
        own = F.col("repository_id") == name
        state = store.publish(name, "1", {"symbols": s.where(own), "call_edges": e.where(own)})
    return state.neighbourhood(m.REPOSITORY, ROOT, 2)


@query("kept_graph_nodes", "SELECT p.symbol_id, p.fqn, near.distance FROM near JOIN p ON p.symbol_id = near.node", *CALLS_AND_EDGES, _NEAR)
def _(spark, d):
    return _graph(spark, d)[0].select("symbol_id", "fqn", "distance")


@query("kept_graph_edges", "SELECT DISTINCT edge_id, a AS caller_symbol_id, b AS callee_symbol_id, unresolved_name FROM e JOIN near ON near.distance < 2 AND (near.node = e.a OR near.node = e.b)", *CALLS_AND_EDGES, _NEAR)
def _(spark, d):
    return _graph(spark, d)[1].select("edge_id", "caller_symbol_id", "callee_symbol_id", "unresolved_name")


#: The calls and their verdicts as the second revision's symbols have them.
_LATER = (P, P2, m.NEXT, m.CALLS.replace("JOIN p a ON", "JOIN p2 a ON"), m.RESOLVED.replace("owner FROM p)", "owner FROM p2)"))


@query("edges_after_edit", "SELECT l_orderkey, rn, caller_symbol_id, CASE WHEN confidence = 'resolved' THEN id END AS callee_symbol_id, confidence, source_line FROM w", *_LATER)
def _(spark, d):
    """The first revision's edges brought up to the second: only calls that an edit can touch are resolved again."""
    a, b = m.symbols(spark, d), m.second_revision(spark, d)
    edges = staged(resolve.resolve_calls(a, m.raw_calls(spark, d), traced=True), "edges")
    gone = a.join(b.select("symbol_id"), "symbol_id", "left_anti").select("repository_id", F.col("symbol_id").alias("caller_symbol_id"))
    found = resolve.resolve_changes(edges, a, b, replaced=gone)
    return found.select("l_orderkey", F.col("rn").cast("bigint").alias("rn"), "caller_symbol_id", "callee_symbol_id", "confidence", "source_line")


@query("redacted_states", """SELECT CAST(symbol_id AS BIGINT) AS id, '{"kind":"state","theirs":{"at":[' || symbol_id || ',{"relativePath":"' || relative_path || '"'
  || CASE WHEN k % 3 = 0 THEN ',"source":"' || fqn || '"' ELSE '' END || ',"fqn":' || CASE WHEN k % 3 = 0 THEN '"' || fqn || '"' ELSE 'null' END || '}]}'
  || CASE WHEN k % 2 = 0 THEN '' ELSE ',"files":["' || relative_path || '"]' END || '}' AS state FROM (SELECT *, CAST(symbol_id AS BIGINT) AS k FROM p)""", P)
def _(spark, d):
    """A state for each symbol, with fields of another program: a file's source and lists of files with sources go, a symbol's source stays."""
    s = m.symbols(spark, d).withColumn("k", F.col("symbol_id").cast("bigint"))
    name = F.concat(F.lit('"'), F.col("fqn"), F.lit('"'))
    files = F.when(F.col("k") % 2 == 0, F.concat(F.lit('[{"source" : '), name, F.lit("}, 1]"))).otherwise(F.concat(F.lit('["'), F.col("relative_path"), F.lit('"]')))
    text = F.concat(F.lit('{"kind": "state", "theirs": {"at": ['), "symbol_id", F.lit(', {"relativePath": "'), "relative_path", F.lit('", "source": '), name, F.lit(', "fqn": '), F.when(F.col("k") % 3 == 0, name).otherwise("null"), F.lit('}]}, "files": '), files, F.lit("}"))
    return redacted_states(s.select(F.col("k").alias("id"), text.alias("state")), "state")
