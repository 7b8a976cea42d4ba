"""Source trees, Git, versioned runs, states and whole analyses."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.functions.hashing import fnv64_of
from graphloom.sources import files, runs, state
from graphloom.sources.extract import analyze, analyze_files, extract


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    texts = {"A.java": "class A { void f() { g(); } void g() { } }\n", "b.php": "<?php\nfunction b() { }\n", "c/d.py": "def d():\n    pass\n", "e.tsx": "function e() { }\n", "note.md": "x", "node_modules/x.ts": "function x() { }", "BIG.PY": "y = 1\n"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe\x00")
    (root / "large.py").write_bytes(b"#" * (files.MAX_BYTES + 1))
    (tmp_path / "outer.py").write_text("secret = 1\n")
    (root / "link.py").symlink_to(tmp_path / "outer.py")
    return root


def test_read_sources(spark, tree):
    got = {r.relative_path: r for r in files.read_sources(spark, str(tree)).collect()}
    assert {p: r.reason for p, r in got.items()} == {"A.java": None, "b.php": None, "c/d.py": None, "e.tsx": None, "node_modules/x.ts": None, "bad.py": "not_utf8", "large.py": "too_large", "link.py": "outside"}
    assert got["A.java"].content_fingerprint == fnv64_of((tree / "A.java").read_text()) and got["large.py"].text is None and got["link.py"].text is None
    web = {r.relative_path for r in files.read_sources(spark, str(tree), web=True).collect()}
    assert "BIG.PY" in web and "node_modules/x.ts" not in web
    ignored = spark.createDataFrame([("b.php",)], "relative_path string")
    assert "b.php" not in {r.relative_path for r in files.read_sources(spark, str(tree), ignored).collect()}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_git(spark, tree):
    with pytest.raises(ValueError):
        files.inspect(spark, str(tree / "none"))
    with pytest.raises(ValueError):
        files.inspect(spark, str(tree))
    git(tree, "init", "-q", "-b", "main")
    (tree / ".gitignore").write_text("b.php\n")
    git(tree, "add", "-A")
    git(tree, "commit", "-q", "-m", "x")
    row = files.inspect(spark, str(tree)).first()
    assert (row.branch, row.is_dirty, row.display_name) == ("main", False, "tree") and row.head
    listed = {r.relative_path for r in files.listed_files(spark, str(tree)).collect()}
    assert {"A.java", "c/d.py"} <= listed and not listed & {"b.php", "note.md"}
    (tree / "A.java").write_text("class A { }\n")
    (tree / "new.py").write_text("z = 1\n")
    assert {r.relative_path for r in files.changed_files(spark, str(tree), "HEAD").collect()} == {"A.java", "new.py"}
    assert files.inspect(spark, str(tree)).first().is_dirty


def test_source_lines(spark, tree):
    symbols = extract(spark.createDataFrame([("java", "A.java", "class A {\n void f() {\n }\n}\n")], "language string, relative_path string, text string"), "r")[0]
    (tree / "A.java").write_text("class A {\n void f() {\n }\n}\n")
    row = files.source_for_symbol(spark, str(tree), symbols, "r", symbols.first().symbol_id).first()
    assert (row.start_line, row.end_line, row.text) == (2, 3, " void f() {\n }")
    with pytest.raises(ValueError):
        files.read_source(spark, str(tree), "../outer.py")
    with pytest.raises(ValueError):
        files.source_for_symbol(spark, str(tree), symbols, "other", "x")


def test_analysis_is_published_whole(spark, tree, tmp_path):
    tables = analyze_files(files.read_sources(spark, str(tree)), "r", "rev1")
    summary = tables.pop("summary").first()
    assert (summary.status, summary.files, summary.symbols, summary.edges, summary.diagnostics) == ("partial", 5, 6, 1, 3)
    root = str(tmp_path / "runs")
    runs.publish(tables, root, "r", 1, "rev1")
    assert runs.current(spark, root, "r", "symbols").count() == 6
    runs.publish({**tables, "symbols": tables["symbols"].where("language = 'php'")}, root, "r", 2, "rev2")
    assert runs.current(spark, root, "r", "symbols").count() == 1 and runs.current(spark, root, "r", "analysis_source_files").count() == 5
    with pytest.raises(ValueError):
        runs.current(spark, root, "other", "symbols")


def test_web_variant_of_extraction():
    text = "function f() { new Thing(1); g(); }\n"
    assert [c["target_name"] for c in analyze("typescript", "a.ts", text).calls] == ["g"]
    assert [c["target_name"] for c in analyze("typescript", "a.ts", text, web=True).calls] == ["Thing", "g"]


def test_many_methods_stay_linear():
    import time

    took = []
    for n in (500, 4000):
        text = "class A {\n" + "".join(f"  void m{i}() {{ m{i + 1}(); }}\n" for i in range(n)) + "}\n"
        began = time.time()
        assert len(analyze("java", "A.java", text).calls) == n
        took.append(time.time() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def states(spark, *texts):
    return state.parse_states(spark.createDataFrame([(json.dumps(t),) for t in texts], "value string"))


def test_state_migration(spark):
    items = [{"id": 1, "memo": "a"}, {"id": 2, "sortOrder": 7}, {"id": 3}]
    data = {"collectionItems": items, "notes": [{"id": 4, "title": "t"}], "counters": {"noteId": 9}, "workspace": {"selectedSymbolId": "s"}, "index": {"symbols": [{"id": "s"}], "edges": [{"id": 1, "source": "s"}], "repository": {"id": "r"}}}
    one, three, bare, empty = states(spark, {"kind": "k", "version": 1, "data": data}, {"kind": "k", "version": 3, "data": data}, data, {}).collect()
    assert [i.sortOrder for i in one.collectionItems] == [0, 7, 2] == [i.sortOrder for i in bare.collectionItems] and [i.sortOrder for i in three.collectionItems] == [None, 7, None]
    assert one.notes[0].title == "t" and one.collectionItems[0].memo == "a" and one["index"].repository.id == "r" and one.counters.noteId == 9 and one.counters.collectionId == 1
    assert one.workspace.graphDepth == 2 and one.workspace.selectedSymbolId == "s" and not one.workspace.reanalysisRequired
    assert empty["index"] is None and empty.notes == [] and empty.collectionItems == []
    lost = {**data, "index": {"edges": [{"id": 1, "source": ""}]}}
    two, kept = states(spark, {"kind": "k", "version": 2, "data": lost}, {"kind": "k", "version": 3, "data": lost}).collect()
    assert two["index"] is None and two.workspace.reanalysisRequired and two.workspace.selectedSymbolId is None and kept["index"] is not None
    with pytest.raises(Exception, match="newer version"):
        states(spark, {"kind": "k", "version": 4, "data": {}}).collect()


def test_state_round_trip(spark, tmp_path):
    data = {"kind": "k", "version": 3, "data": {"notes": [{"id": 1, "title": "é", "tags": ["a"]}], "index": {"symbols": [], "edges": []}, "files": [{"relativePath": "a", "source": "raw text"}]}}
    first = states(spark, data)
    path = str(tmp_path / "state")
    state.write_state(first, path)
    text = "".join(p.read_text() for p in (tmp_path / "state").glob("part-*"))
    assert "raw text" not in text and json.loads(text)["version"] == 3
    assert state.read_state(spark, path).collect() == first.collect()
    assert state.read_state(spark, str(tmp_path / "none")).first().notes == []


GOOD = {"version": 1, "activeWorkspace": "find", "query": "q", "depth": 2, "noteDrafts": [{}, {}], "selectedNoteId": 3, "lineReferenceRange": {"start": 2, "end": 4}, "graphViewport": {"zoom": 1.5, "panX": 0, "panY": -1}, "sourceScrollTop": 12.5, "markdownSelection": {"start": 0, "end": 0}, "markdownScrollTop": -1, "selectedCollectionId": "x"}


def parsed(spark, *states_):
    df = spark.createDataFrame([(s if isinstance(s, str) else json.dumps(s),) for s in states_], "state_json string")
    return df.select(*state.workspace_state()).collect()


def test_workspace_states(spark):
    (row,) = parsed(spark, GOOD)
    assert (row.valid, row.active_workspace, row.query, row.depth, row.drafts, row.selected_note_id, row.selected_collection_id) == (True, "explore", "q", 2, 2, 3, None)
    assert tuple(row.line_range) == (2, 4) and tuple(row.viewport) == (1.5, 0.0, -1.0) and row.source_scroll_top == 12.5 and tuple(row.markdown_selection) == (0, 0) and row.markdown_scroll_top == 0
    bad = [{**GOOD, "version": 2}, {**GOOD, "activeWorkspace": "x"}, {**GOOD, "query": 1}, {**GOOD, "depth": 4}, {**GOOD, "depth": 1.5}, {**GOOD, "noteDrafts": {}}, {}, "not json", "[]", "null"]
    assert [r.valid for r in parsed(spark, *bad)] == [False] * len(bad)
    (odd,) = parsed(spark, {**GOOD, "lineReferenceRange": {"start": 0, "end": 4}, "graphViewport": {"zoom": 0, "panX": 0, "panY": 0}, "markdownSelection": {"start": 3, "end": 2}, "selectedNoteId": 1.5, "sourceScrollTop": "a"})
    assert odd.valid and odd.line_range is odd.viewport is odd.markdown_selection is odd.selected_note_id is None and odd.source_scroll_top == 0


def test_workspace_round_trip(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),)], "state_json string").select(*state.workspace_state())
    again = df.select(state.workspace_json().alias("state_json")).select(*state.workspace_state())
    assert again.drop("drafts").collect() == df.drop("drafts").collect()


def test_written_exports(spark, tmp_path):
    from graphloom.operators import exports

    rows = spark.createDataFrame([(1, "<p>a</p>", "a"), (2, "<p>b</p>", "b\nc")], "id bigint, html string, text string")
    exports.write_exports(rows, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x/id=2/format=text"), wholetext=True).first().value.rstrip("\n") == "b\nc"
    assert spark.read.text(str(tmp_path / "x/id=1/format=html")).first().value == "<p>a</p>"


def test_web_repository(spark):
    from graphloom.operators import mutations

    rows = spark.createDataFrame([("b", "2"), ("a", "1")], "relative_path string, text string")
    one = mutations.web_repository(rows, "r", "n", F.col("text")).first()
    again = mutations.web_repository(rows.orderBy("text"), "r", "n", F.col("text"), spark.createDataFrame([("r", None)], "id string, created_at timestamp")).first()
    assert one.head == again.head and one.branch == "browser" and again.created_at is not None
