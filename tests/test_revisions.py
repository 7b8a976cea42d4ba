"""Incremental resolving against a full one, seed sets against plain searches, redaction, and the adjacency store."""

import json
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from graphloom.operators import adjacency, graph, resolve
from graphloom.schemas import TABLES
from graphloom.sources import state, store

SYMBOL = "repository_id string, symbol_id string, language string, relative_path string, fqn string"
CALL = "repository_id string, call_seq bigint, caller_symbol_id string, language string, target_name string, display_target string, is_qualified boolean, receiver_type string, receiver_module string, source_line int"


def drawn(rng, ids):
    """Symbols of few names, scopes and files, so that keys meet."""
    out = []
    for i in ids:
        language = rng.choice(["php", "typescript"])
        path = rng.choice(["a/x.ts", "a/index.ts", "b/y.d.ts", "z.php"])
        out.append((rng.choice("rq"), str(i), language, path, rng.choice(["M", "N", ""]) + rng.choice([".A", ".B"]) + "." + rng.choice(["go", "Go", "run", "stop"])))
    return out


def calls_of(rng, ids, first):
    out = []
    for seq, i in enumerate(ids, first):
        name = rng.choice(["go", "Go", "run", "stop", "none"])
        qualified = rng.random() < 0.4
        typed = rng.choice([None, None, "A", "B"])
        out.append((rng.choice("rq"), seq, str(i), rng.choice(["php", "typescript"]), name, f"x.{name}" if qualified else name, qualified, typed, rng.choice([None, "./x", "../a", "./index"]) if typed else None, seq))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_resolve_changes_equals_a_full_resolve(spark, seed):
    rng = random.Random(seed)
    first = drawn(rng, range(40))
    calls = calls_of(rng, [rng.randrange(45) for _ in range(300)], 0)  # some callers are no symbols
    second = [s for s in first if rng.random() < 0.9]
    second = [(*s[:3], "moved/x.ts", s[4]) if rng.random() < 0.08 else (*s[:4], s[4] + "2") if rng.random() < 0.08 else s for s in second] + drawn(rng, range(40, 44))
    now = [c for c in calls if int(c[2]) % 9] + calls_of(rng, [9, 18, 41, 42], 1000)  # the calls of every ninth caller are replaced
    a, b = spark.createDataFrame(first, SYMBOL), spark.createDataFrame(second, SYMBOL)
    edges = resolve.resolve_calls(a, spark.createDataFrame(calls, CALL), traced=True)
    replaced = spark.createDataFrame([(r, str(i)) for r in "rq" for i in range(0, 45, 9)], "repository_id string, caller_symbol_id string")
    files = spark.createDataFrame([(r, p) for r in "rq" for p in {s[3] for s in set(first) ^ set(second)}], "repository_id string, relative_path string")
    fresh = spark.createDataFrame([c for c in now if c[1] >= 1000], CALL)
    got = resolve.resolve_changes(edges, a, b, files, replaced, fresh)
    full = resolve.resolve_calls(b, spark.createDataFrame(now, CALL), traced=True)
    rows = lambda df: sorted(map(repr, df.select(*full.columns).collect()))
    assert rows(got) == rows(full)


def test_only_touched_calls_are_resolved_again(spark):
    first = [("r", "1", "java", "A.java", "A.get"), ("r", "2", "java", "A.java", "A.use"), ("r", "3", "java", "B.java", "B.main"), ("r", "4", "java", "B.java", "B.one"), ("r", "5", "java", "T.java", "T.put")]
    call = lambda seq, by, name, typed=None: ("r", seq, by, "java", name, name, False, typed, None, seq)
    calls = spark.createDataFrame([call(1, "2", "get"), call(2, "3", "get"), call(3, "3", "one"), call(4, "3", "put", "T"), call(5, "3", "put")], CALL)
    a = spark.createDataFrame(first, SYMBOL)
    b = spark.createDataFrame([*first, ("r", "6", "java", "C.java", "C.get"), ("r", "7", "java", "C.java", "C.put")], SYMBOL)
    edges = resolve.resolve_calls(a, calls, traced=True)
    judged = {r.call_seq: r.again for r in resolve.to_resolve_again(edges, resolve.touched_symbols(a, b)).collect()}
    assert judged == {1: False, 2: True, 3: False, 4: False, 5: True}  # 1 by its scope, 4 by its type
    got = {r.call_seq: r.confidence for r in resolve.resolve_changes(edges, a, b).collect()}
    assert got == {1: "resolved", 2: "ambiguous", 3: "resolved", 4: "resolved", 5: "ambiguous"}
    same = resolve.resolve_changes(edges, a, a)
    assert same.exceptAll(edges).isEmpty() and same.count() == 5
    none = resolve.resolve_changes(edges, a, a.limit(0))
    assert {r.confidence for r in none.collect()} == {"unresolved"}
    assert resolve.resolve_changes(edges.limit(0), a, b).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_seed_sets_equal_plain_searches(spark, seed):
    """More than 64 seeds, so that there are several words; a hub that all of them reach; loops and repeated calls."""
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(150)), str(rng.randrange(150))) for _ in range(250)] + [("hub", str(i)) for i in range(150)] + [("top", "hub"), ("hub", "hub"), ("top", "hub"), ("far", "top"), ("farther", "far")]
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(999, "1", None)], "edge_id bigint, caller_symbol_id string, callee_symbol_id string")
    seeds = [str(i) for i in range(0, 150, 1 + seed)] + ["alone", "top"]
    back = defaultdict(set)
    for a, b in pairs:
        back[b].add(a)
    want = set()
    for s in seeds:
        at, queue = {s: 0}, deque([s])
        while queue:
            n = queue.popleft()
            for c in back[n]:
                if at[n] < 3 and c not in at:
                    at[c] = at[n] + 1
                    queue.append(c)
        want |= {(s, n, d) for n, d in at.items() if d}
    asked = spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]], "seed string")
    got = [tuple(r) for r in graph.reverse_reach(edges, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sets = graph.reverse_sets(graph.callers(edges), graph.numbered(asked)).where("node = 'hub'")
    assert sets.count() <= 2 * (len(seeds) // 64 + 1)
    assert graph.reverse_reach(edges, asked.limit(0)).isEmpty() and graph.reverse_reach(edges.limit(0), asked).isEmpty()


def test_kept_adjacency(spark, tmp_path):
    """Equal to the plain neighbourhood with few and many buckets, a hub of more neighbours than are named, loops and open calls;
    and the hops open no bucket but those of their frontiers."""
    rng = random.Random(0)
    pairs = [(str(rng.randrange(200)), str(rng.randrange(200)) if rng.random() < 0.8 else None) for _ in range(220)] + [("hub", str(i)) for i in range(90)] + [("0", "hub"), ("0", "0"), ("lone", None)]
    edges = spark.createDataFrame([("r", i, a, b, None if b else "x", "resolved" if b else "unresolved", i) for i, (a, b) in enumerate(pairs)], TABLES["call_edges"])
    symbols = spark.createDataFrame([("r", str(i), "java", "method", f"A.f{i}", "()", "p", 1, 2, "h") for i in [*range(190), "hub", "lone"]], TABLES["symbols"])
    for rows in (40, 10_000):
        kept = adjacency.write(f"file://{tmp_path}/a{rows}", edges, rows)
        assert kept["buckets"] == max(1, -(-2 * len(pairs) // rows))
        for root, depth, name in (("0", 3, "neighbourhood"), ("hub", 1, "discovered_graph"), ("nobody", 2, "neighbourhood")):
            got, want = getattr(adjacency, name)(spark, kept, symbols, root, depth), getattr(graph, name)(symbols, edges, root, depth)
            for g, w in zip(got, want, strict=True):
                assert sorted(map(repr, g.select(*w.columns).collect())) == sorted(map(repr, w.collect())), (rows, root, depth)
    kept = adjacency.write(f"file://{tmp_path}/b", edges, 20)
    mine = spark.createDataFrame([("lone",)], "node string").select(adjacency.bucket(F.col("node"), kept["buckets"])).first()[0]
    for folder in (tmp_path / "b").glob("bucket=*"):
        if folder.name != f"bucket={mine}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not to be read")
    nodes, found = adjacency.neighbourhood(spark, kept, symbols, "lone", 3)
    assert [r.symbol_id for r in nodes.collect()] == ["lone"] and found.count() == 1
    empty = adjacency.write(f"file://{tmp_path}/c", edges.limit(0))
    assert [n.count() for n in adjacency.neighbourhood(spark, empty, symbols, "0", 2)] == [1, 0]


def test_adjacency_is_published(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    symbols = spark.createDataFrame([("r", str(i), "java", "method", f"A.f{i}", "()", "p", 1, 2, "h") for i in range(3)], TABLES["symbols"])
    edge = lambda *ends: spark.createDataFrame([("r", i, a, b, None, "resolved", 1) for i, (a, b) in enumerate(ends)], TABLES["call_edges"])
    first = s.publish("r", "1", {"symbols": symbols, "call_edges": edge(("0", "1"))})
    second = s.publish("r", "2", {"symbols": symbols, "call_edges": edge(("0", "1"), ("1", "2"))})
    third = s.publish("r", "3", {"symbols": symbols})  # no edges: none of the old analysis either
    near = lambda state: sorted(r.symbol_id for r in state.neighbourhood("r", "0", 2)[0].collect())
    assert [near(x) for x in (first, second, third, first)] == [["0", "1"], ["0", "1", "2"], ["0"], ["0", "1"]]
    assert second.neighbourhood("q", "0", 2)[0].isEmpty()


def test_redaction(spark):
    file, symbol = {"relativePath": "a.ts", "source": "x", "n": 1.5}, {"relativePath": "a.ts", "source": "x", "fqn": "A.f"}
    deep = file
    for _ in range(60):
        deep = {"in": [deep]}
    cases = [
        (file, {"relativePath": "a.ts", "n": 1.5}),
        (symbol, symbol),
        ({"relativePath": "a.ts", "source": 5}, {"relativePath": "a.ts", "source": 5}),
        ({"source": "an edge's end", "target": "b"}, {"source": "an edge's end", "target": "b"}),
        ({"files": [symbol, 1], "more": {"files": [file]}, "files2": []}, {"more": {}, "files2": []}),
        ({"files": ["a", {"path": "b"}], "é": None}, {"files": ["a", {"path": "b"}], "é": None}),
        ([file, [symbol, "s", None]], [{"relativePath": "a.ts", "n": 1.5}, [symbol, "s", None]]),
        (deep, json.loads(json.dumps(deep).replace('"source": "x", ', ""))),
        ("text", "text"),
    ]
    texts = [json.dumps(a) for a, _ in cases] + [None, "", "{", "NaN", '{"a":"\\ud800"}', "[" * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    got = [r.value for r in state.redacted_states(rows).orderBy("id").collect()]
    assert [json.loads(t) for t in got[: len(cases)]] == [b for _, b in cases]
    assert got[len(cases) :] == [None, None, None, None, '{"a":"\\ud800"}', None]
    assert state.redacted_states(rows.limit(0)).isEmpty()
