"""Symbol search over names with accents, which the tables don't have."""

from graphloom.operators import search

SCHEMA = "symbol_id string, fqn string, signature string, relative_path string"


def test_accents_do_not_count(spark):
    names = {"1": "a.\u00c9lan_vital", "2": "a.E\u0301lan", "3": "a.elan", "4": "a.other"}
    symbols = spark.createDataFrame([(i, n, "()", "x") for i, n in names.items()], SCHEMA)
    for query in ("elan", "ELA", "\u00c9lan", "e\u0301la"):
        assert {r["symbol_id"] for r in search.search(symbols, query).collect()} == {"1", "2", "3"}, query
    assert {r["symbol_id"] for r in search.search(symbols, "\u00e9lan_v").collect()} == {"1"}
