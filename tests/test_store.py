"""The store: commits that race or fail, parts that are rewritten, the kept index, snapshots; and discovery order."""

import random
import threading
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, index, lifecycle, search
from graphloom.schemas import TABLES
from graphloom.sources import commits, store

SYMBOL = TABLES["symbols"]


def symbols(spark, *rows, repository="r"):
    return spark.createDataFrame([(repository, i, "java", "method", f, "()", p, 1, 2, h) for i, f, p, h in rows], SYMBOL)


FIRST = [("1", "A.read_file", "A.java", "h1"), ("2", "A.readAll", "A.java", "h2"), ("3", "B.write_file", "B.java", "h3")]
SECOND = [("1", "A.read_file", "A.java", "h1"), ("2", "A.readAll", "moved/A.java", "h2"), ("9", "B.write_file", "B.java", "h9")]


def note(i, symbol, fqn, status="linked"):
    return (i, "r", symbol, fqn, "()", "t", "", [], status, None, None)


def seeded(spark, tmp_path, **options):
    s = store.Store(spark, f"file://{tmp_path}/store", **options)
    s.create("notes", spark.createDataFrame([note(1, "1", "A.read_file"), note(2, "3", "B.write_file"), note(3, "x", "C.gone"), (70_000, "q", "3", "B.write_file", "()", "t", "", [], "linked", None, None)], TABLES["notes"]))
    return s


def links(state):
    return {r.id: (r.symbol_id, r.status) for r in state.table("notes").collect()}


def test_log_gives_a_number_once(spark, tmp_path):
    log = commits.Log(spark, f"file://{tmp_path}/log")
    got = []

    def write(k):
        try:
            log.put(1, {"by": k})
            got.append(k)
        except commits.Taken:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 1 and log.read(1) == {"by": got[0]} and log.last() == 1
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")) == ["00000000000000000001.json"]


def test_publish_relinks_in_one_commit(spark, tmp_path):
    s = seeded(spark, tmp_path)
    first = s.publish("r", "1", {"symbols": symbols(spark, *FIRST), "diagnostics": spark.createDataFrame([], "message string")})
    assert links(first) == {1: ("1", "linked"), 2: ("3", "linked"), 3: ("x", "orphan"), 70_000: ("3", "linked")}
    second = s.publish("r", "2", {"symbols": symbols(spark, *SECOND), "diagnostics": spark.createDataFrame([("broken",)], "message string")})
    assert links(second)[2] == ("9", "linked") and second.table("symbols").count() == 3
    assert [(r.id, r.status) for r in second.table("analysis_runs").orderBy("id").collect()] == [(1, "completed"), (2, "partial")]
    assert links(first)[2] == ("3", "linked") and first.of_repository("symbols", "r").where("symbol_id = '9'").count() == 0  # a reader keeps its entry
    other = s.publish("q", "1", {"symbols": symbols(spark, *FIRST, repository="q")})
    assert other.table("symbols").count() == 6 and other.of_repository("symbols", "r").count() == 3


def test_killed_and_concurrent_publishes(spark, tmp_path, monkeypatch):
    s = seeded(spark, tmp_path)
    before = s.publish("r", "1", {"symbols": symbols(spark, *FIRST)})
    put, indexed = commits.Log.put, store.Store._indexed

    def killed(*_):
        raise RuntimeError("killed")

    for name, owner in (("_indexed", store.Store), ("_written", store.Store)):
        with monkeypatch.context() as patch:
            if name == "_indexed":
                patch.setattr(owner, name, killed)
            else:  # the running run is written, the re-linked notes aren't
                calls = []
                written = store.Store._written
                patch.setattr(owner, name, lambda self, table, *a: killed() if table == "notes" else calls.append(table) or written(self, table, *a))
            with pytest.raises(RuntimeError):
                s.publish("r", "2", {"symbols": symbols(spark, *SECOND)})
        now = s.state()
        assert links(now) == links(before) and now.entry["index"] == before.entry["index"]
        assert {r.symbol_id for r in now.table("symbols").collect()} == {"1", "2", "3"}
        assert {r.status for r in now.table("analysis_runs").where("id > 1").collect()} == {"running"}

    raced = threading.Barrier(2)
    first_try = threading.local()

    def slow(self, number, entry):
        if not getattr(first_try, "done", False) and any(len(p) > 1 for p in entry["index"].values()):
            first_try.done = True
            raced.wait(60)  # both have worked out the same number
        put(self, number, entry)

    monkeypatch.setattr(commits.Log, "put", slow)
    third = [*SECOND[:2], ("7", "B.write_file", "B.java", "h7")]
    threads = [threading.Thread(target=s.publish, args=("r", rev, {"symbols": symbols(spark, *rows)})) for rev, rows in (("2", SECOND), ("3", third))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    end = s.state()
    ids = {r.symbol_id for r in end.of_repository("symbols", "r").collect()}
    assert ids in ({"1", "2", "9"}, {"1", "2", "7"}) and links(end)[2] == ((ids - {"1", "2"}).pop(), "linked")  # one analysis, whole
    assert end.table("analysis_runs").where("status = 'completed'").count() == 3
    same_rows(spark, end, end.of_repository("symbols", "r"))
    assert indexed is store.Store._indexed


def same_rows(spark, state, now, queries=("read", "a read", "file", "read_f", "write_file b", "gone", "r", "", "..", "a java")):
    for q in queries:
        kept = [(r.symbol_id, r.fqn, r.score) for r in state.search("r", q).collect()]
        assert kept == [(r.symbol_id, r.fqn, r.score) for r in search.search(now, q).collect()], q


def test_kept_index_over_many_analyses(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SEGMENTS", 3)
    s = store.Store(spark, f"file://{tmp_path}/store")
    draw = random.Random(4)
    counts = []
    for revision in range(4):
        rows = [(str(i), f"{draw.choice('AB')}.{draw.choice(['read', 'write', 'é'])}_{draw.choice(['file', 'all'])}", draw.choice(["A.java", "B.java"]), "h") for i in draw.sample(range(12), 8)]
        now = symbols(spark, *rows)
        state = s.publish("r", str(revision), {"symbols": now})
        counts.append(len(state.entry["index"]["r"]))
        same_rows(spark, state, now)
    assert counts == [1, 2, 1, 2]
    empty = s.publish("r", "none", {"symbols": symbols(spark)})
    assert empty.search("r", "read").count() == 0 and empty.search("unknown", "read").count() == 0


def test_kept_index_reads_its_buckets_alone(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    state = s.publish("r", "1", {"symbols": symbols(spark, *[(str(i), f"{chr(97 + i % 26)}x.f{i}", "p.java", "h") for i in range(200)])})
    asked = lambda q: index._in_buckets(q) & F.col("token").startswith(q)
    everything = index.read(spark, state.entry["index"]["r"], F.lit(True))
    buckets = {f.split("bucket=")[1].split("/")[0] for f in everything.inputFiles()}
    found = index.read(spark, state.entry["index"]["r"], asked("ax"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) > 20 and "PartitionFilters" in plan and "StringStartsWith(token,ax)" in plan
    assert {r.bucket for r in found.select("bucket").distinct().collect()} == {"617"}


def test_merges_write_touched_parts_alone(spark, tmp_path):
    s = seeded(spark, tmp_path, width=10)
    many = spark.range(100, 200).select(F.col("id"), F.lit("r").alias("repository_id"), F.lit("1").alias("symbol_id"), F.lit("A.read_file").alias("symbol_fqn"), F.lit("()").alias("symbol_signature"))
    s.merge("notes", lambda state: store._filled(many, state.table("notes")))
    s.publish("r", "1", {"symbols": symbols(spark, *FIRST)})
    before = s.state()
    asked = spark.createDataFrame([("r", "1", 105, "new", "b", ["x"]), ("r", "1", 151, "new", "b", []), ("r", "gone", 160, "no", "b", [])], "repository_id string, symbol_id string, id bigint, title string, body_markdown string, tags array<string>")
    after = s.update_notes(asked)
    parts = lambda state: state.entry["tables"]["notes"]["parts"]
    assert {p for p in parts(after) if parts(after)[p] != parts(before).get(p)} == {"10", "15", "16"}
    assert {r.id for r in after.table("notes").where("title = 'new'").collect()} == {105, 151} and after.table("notes").count() == before.table("notes").count()
    made = s.create_notes(spark.createDataFrame([("r", "1", "one"), ("r", "3", "two"), ("r", "gone", "no")], "repository_id string, symbol_id string, title string"))
    assert {p for p in parts(made) if parts(made)[p] != parts(after).get(p)} == {"7000"}
    assert {(r.id, r.title) for r in made.table("notes").where("id > 70000").collect()} == {(70_001, "one"), (70_002, "two")}
    saved = s.save_notes(spark.createDataFrame([("r", "3", "body", ["t"]), ("r", "2", "fresh", [])], "repository_id string, symbol_id string, body_markdown string, tags array<string>"))
    assert {(r.symbol_id, r.id) for r in saved.table("notes").where("body_markdown in ('body', 'fresh')").collect()} == {("2", 70_003), ("3", 70_002)}
    gone = s.merge("notes", lambda state: state.table("notes").limit(0), lambda state: state.table("notes").where("id = 151"))
    assert gone.table("notes").where("id = 151").count() == 0 and gone.top("notes") == 70_003


def test_collections_and_items_in_one_commit(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.create("repositories", spark.createDataFrame([("r", "head")], "id string, head string"), "''")
    s.create("analysis_runs", spark.createDataFrame([], TABLES["analysis_runs"]))
    s.create("collections", spark.createDataFrame([], TABLES["collections"]))
    s.create("collection_items", spark.createDataFrame([], TABLES["collection_items"]))
    made = s.create_collections(spark.createDataFrame([("r", " a ", "o", ["t"]), ("r", "b", "o", []), ("unknown", "c", "o", [])], "repository_id string, title string, overview_markdown string, tags array<string>"), F.to_timestamp(F.lit("2020-01-01")))
    assert {(r.id, r.title, r.created_revision) for r in made.table("collections").collect()} == {(1, "a", "head"), (2, "b", "head")}
    new = spark.createDataFrame([(1, "r", "1", "A.f", "()", "p"), (1, "r", "2", "A.g", "()", "p"), (1, "r", "1", "A.f", "()", "p")], "collection_id bigint, repository_id string, symbol_id string, symbol_fqn string, symbol_signature string, relative_path string")
    added = s.add_items(new)
    assert {(r.id, r.sort_order) for r in added.table("collection_items").collect()} == {(1, 0), (2, 1)}
    again = s.add_items(new.withColumn("symbol_fqn", F.concat("symbol_fqn", F.lit("2"))))
    assert {(r.id, r.sort_order) for r in again.table("collection_items").collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    touched = {r.id: r.updated_at.year > 2020 for r in again.table("collections").collect()}
    assert touched == {1: True, 2: False}
    end = s.delete_collections(spark.createDataFrame([(1,)], "id bigint"))
    assert end.table("collection_items").count() == 0 and [r.id for r in end.table("collections").collect()] == [2]


ASKED = "repository_id string, schema_version int, app_version string, database_format_version int, state_json string, place int"


def test_snapshots_are_promoted_whole(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.create("repositories", spark.createDataFrame([("r",), ("q",)], "id string"), "''")
    asked = lambda *states, version=1, repository="r": spark.createDataFrame([(repository, version, "v", 1, t, i) for i, t in enumerate(states)], ASKED)
    rows = lambda state: {(r.repository_id, r.state_json, r.status) for r in state.table("workspace_snapshots").collect()}
    assert rows(s.save_snapshots(asked('{"a": 1}'))) == {("r", '{"a": 1}', "current")}
    assert rows(s.save_snapshots(asked('{"a": 2}'))) == {("r", '{"a": 2}', "current"), ("r", '{"a": 1}', "previous_valid")}
    s.save_snapshots(asked("{}", repository="q"))
    third = s.save_snapshots(asked('{"a": 3}', '{"a": 4}'))
    kept = {("r", '{"a": 4}', "current"), ("r", '{"a": 3}', "previous_valid"), ("q", "{}", "current")}
    assert rows(third) == kept and {r.snapshot_id for r in third.table("workspace_snapshots").collect()} == {3, 4, 5}
    for bad in (asked("[]"), asked("{}", version=9), asked("{}", repository="unknown"), asked("{}", "{")):
        with pytest.raises(ValueError):
            s.save_snapshots(bad)
        assert rows(s.state()) == kept and s.log.last() == third.number

    def fails(*_, **__):
        raise RuntimeError("fault")

    for owner, name in ((store, "staged"), (store.lifecycle, "valid_snapshot"), (store.mutations, "_placed"), (store.lifecycle, "snapshot_statuses"), (store.Store, "_written"), (commits.Log, "put"), (commits.Log, "_named")):
        with monkeypatch.context() as patch:
            patch.setattr(owner, name, fails)
            with pytest.raises(RuntimeError):
                s.save_snapshots(asked('{"a": 9}'))
        assert rows(s.state()) == kept and s.log.last() == third.number, name


def plain_discovery(nodes, edges, root, depth):
    if root not in nodes:
        return []
    near = {}
    for i, a, b in sorted(edges):
        near.setdefault(a, []).append((a, b))
        if b:
            near.setdefault(b, []).append((a, b))
    found, queue = {root: 0}, deque([root])
    while queue:
        at = queue.popleft()
        if found[at] < depth:
            for pair in near.get(at, []):
                for to in pair:
                    if to and to not in found:
                        found[to] = found[at] + 1
                        queue.append(to)
    return [(n, d) for n, d in found.items() if n in nodes]


def test_discovery_order_is_that_of_a_search(spark):
    for seed in range(3):
        draw = random.Random(seed)
        nodes = [str(i) for i in range(30)]
        edges = [(i, draw.choice(nodes), draw.choice([*nodes, "gone", None])) for i in range(60)]
        table = spark.createDataFrame([(n,) for n in nodes], "symbol_id string")
        links_ = spark.createDataFrame(edges, "edge_id bigint, caller_symbol_id string, callee_symbol_id string")
        for depth in (1, 3):
            got = graph.discovery_order(table, links_, "0", depth).orderBy("place").collect()
            assert [(r.symbol_id, r.distance) for r in got] == plain_discovery(set(nodes), edges, "0", depth)
            assert [r.place for r in got] == list(range(1, len(got) + 1))
    assert graph.discovery_order(table, links_, "unknown", 2).count() == 0


def test_changed_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id bigint, v string")
    new = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "d")], "id bigint, v string")
    assert {r.id for r in store._changed(old, new).collect()} == {2, 3, 4}
    assert lifecycle.lookup(old, id=1).count() == 1
