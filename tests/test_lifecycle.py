"""Single changes of items and notes, reports, and repositories that must not see each other."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import impact, lifecycle, mutations, orders, resolve, search

SYMBOL = "repository_id string, symbol_id string, language string, kind string, fqn string, signature string, relative_path string, start_line int, end_line int, ast_fingerprint string"
ITEM = "id bigint, collection_id bigint, repository_id string, symbol_id string, symbol_fqn string, symbol_signature string, relative_path string, start_line int, end_line int, ast_fingerprint string, role string, memo string, status string, sort_order bigint"
NOTE = "id bigint, repository_id string, symbol_id string, symbol_fqn string, symbol_signature string, title string, body_markdown string, tags array<string>, status string, updated_at timestamp"


def symbols(spark, *rows):
    return spark.createDataFrame([(r, i, "java", "method", f, "()", p, 1, 2, h) for r, i, f, p, h in rows], SYMBOL)


def items(spark, *rows):
    return spark.createDataFrame([(i, c, "r", s, f, "()", "p", 1, 2, h, "core", "m", st, o) for i, c, s, f, h, st, o in rows], ITEM)


def test_two_repositories(spark):
    """The same names stand in both: nothing of one may resolve, re-link, match or count in the other."""
    both = symbols(spark, ("r", "1", "A.f", "A.java", "h1"), ("r", "2", "A.g", "A.java", "h2"), ("q", "3", "A.f", "A.java", "h3"), ("q", "4", "B.k", "B.java", "h4"))
    calls = spark.createDataFrame([("r", 1, "1", "java", "k"), ("r", 2, "1", "java", "g"), ("q", 3, "4", "java", "f")], "repository_id string, call_seq bigint, caller_symbol_id string, language string, target_name string")
    calls = calls.withColumns({"display_target": F.col("target_name"), "is_qualified": F.lit(False), "receiver_type": F.lit(None).cast("string"), "receiver_module": F.lit(None).cast("string"), "source_line": F.lit(1)})
    got = {r.call_seq: (r.confidence, r.callee_symbol_id) for r in resolve.resolve_calls(both, calls).collect()}
    assert got == {1: ("unresolved", None), 2: ("resolved", "2"), 3: ("resolved", "3")}
    note = spark.createDataFrame([(1, "q", "9", "A.g", "()", "t", "", [], "linked", None), (2, "q", "9", "A.f", "()", "t", "", [], "orphan", None)], NOTE)
    assert {r.id: (r.status, r.symbol_id) for r in lifecycle.relink_notes(note, both).collect()} == {1: ("orphan", "9"), 2: ("linked", "3")}
    assert lifecycle.unique_match(both, ["fqn"]).count() == 4
    changed = impact.diff_symbols(both, both.where("repository_id = 'r'")).collect()
    assert {(c.repository_id, c.fqn, c.kind) for c in changed} == {("q", "A.f", "deleted"), ("q", "B.k", "deleted")}
    (mine,) = lifecycle.within("r", both)
    assert [r.symbol_id for r in search.search(mine, "A f").collect()] == ["1"]
    moved = items(spark, (1, 1, "gone", "B.k", "h4", "linked", 0))
    assert lifecycle.relink_items(moved, both).first().status == "orphan"


def test_item_chain(spark):
    now = symbols(spark, ("r", "1", "A.f", "p", "new"), ("r", "2", "A.g", "p", "h2"))
    rows = items(spark, (1, 1, "1", "A.f", "old", "linked", 0), (2, 1, "2", "A.g", "h2", "linked", 10), (3, 1, None, "A.z", "h9", "orphan", 20))
    assert [r.is_changed for r in lifecycle.item_details(rows, now).orderBy("id").collect()] == [True, False, False]
    reviewed = lifecycle.mark_reviewed(rows.withColumn("reviewed_at", F.lit(None).cast("timestamp")), now, 1)
    assert not lifecycle.item_details(reviewed, now).where("is_changed").count() and reviewed.where("reviewed_at is not null").count() == 1
    assert lifecycle.relink_item(rows, now, 3, "2").where("id = 3").first().status == "orphan"  # another item has it
    free = symbols(spark, ("r", "1", "A.f", "p", "new"), ("r", "2", "A.g", "p", "h2"), ("r", "5", "A.y", "p", "h5"))
    assert lifecycle.relink_item(rows, free, 3, "5").where("id = 3").first().symbol_fqn == "A.y"
    assert [r.sort_order for r in lifecycle.remove_item(rows, 2).orderBy("id").collect()] == [0, 1]
    assert lifecycle.neighbour_swap(rows, 3, -1).first().ids == [1, 3, 2] and lifecycle.neighbour_swap(rows, 3, 1).first().ids == [1, 2, 3]
    new = items(spark, (0, 1, "7", "A.n", "h", "linked", 0), (0, 1, "1", "A.f", "old", "linked", 0)).drop("id", "sort_order")
    added = lifecycle.add_items(rows, new).where("symbol_fqn = 'A.n'").collect()
    assert [(r.id, r.sort_order) for r in added] == [(4, 21)] and lifecycle.add_items(rows, new).count() == 4


def test_statuses(spark):
    none, one = spark.createDataFrame([], "relative_path string"), spark.createDataFrame([("a",)], "relative_path string")
    assert [impact.impact_status(known, rows, none).first().status for known, rows in ((False, one), (True, one), (True, none))] == ["noBaseline", "changed", "unchanged"]
    log = spark.createDataFrame([(1, "{}", "v", "r", 1), (1, "[]", "v", "r", 1), (1, "{}", " ", "r", 1), (9, "{}", "v", "r", 1), (1, "{", "v", "r", 1)], "schema_version int, state_json string, app_version string, repository_id string, database_format_version int")
    assert [r[0] for r in log.select(lifecycle.valid_snapshot(1)).collect()] == [True, False, False, False, False]


def test_orders(spark):
    changes = spark.createDataFrame([("b", "p", "p", "added"), ("a", "q", "q", "deleted"), ("a", "q", "q", "added")], "fqn string, current_path string, base_path string, kind string")
    assert [(r.fqn, r.kind) for r in impact.report_order(changes).collect()] == [("a", "added"), ("a", "deleted"), ("b", "added")]
    callers = spark.createDataFrame([(2, "a", "p", "1"), (1, "b", "p", "2"), (1, "b", "a", "3")], "distance int, fqn string, relative_path string, symbol_id string")
    assert [r.symbol_id for r in orders.ordered(orders.AFFECTED_CALLERS, callers).collect()] == ["3", "2", "1"]
    assert [r.place for r in orders.placed(orders.AFFECTED_CALLERS, callers).orderBy("place").collect()] == [1, 2, 3]


def test_refused_requests(spark):
    now = symbols(spark, ("r", "1", "A.f", "p", "h"))
    notes = spark.createDataFrame([(5, "r", "1", "A.f", "()", "t", "", [], "linked", None)], NOTE)
    asked = spark.createDataFrame([("r", "1", "a"), ("r", "x", "b"), ("q", "1", "c")], "repository_id string, symbol_id string, title string")
    assert sorted((r.id, r.title) for r in mutations.create_notes(notes, now, asked).collect()) == [(5, "t"), (6, "a")]
    done, refused = mutations.web_create_notes(notes, now, asked)
    assert done.count() == 1 and [r.title for r in refused.collect()] == ["a"]
    rows = spark.createDataFrame([(1, "r", "old", "o", ["a"])], "id bigint, repository_id string, title string, overview_markdown string, tags array<string>").withColumn("updated_at", F.lit(None).cast("timestamp"))
    change = spark.createDataFrame([("r", 1, "  ", "n", [" b ", ""]), ("q", 1, "x", "n", [])], "repository_id string, id bigint, title string, overview_markdown string, tags array<string>")
    done, refused = mutations.update_collections(rows, change)
    assert done.first().title == mutations.UNTITLED and done.first().tags == ["b"] and [r.repository_id for r in refused.collect()] == ["q"]
    assert mutations.widened_symbols(now.drop("kind"), {"symbol_id": "string", "kind": "string"}).first().kind is None


@pytest.mark.parametrize("query", ["elan", "Élan", "ELAN*", "élan"])
def test_accents(spark, query):
    rows = symbols(spark, ("r", "1", "A.Élan", "p", "h"), ("r", "2", "A.other", "p", "h"))
    assert [r.symbol_id for r in search.search(rows, query).collect()] == ["1"]
