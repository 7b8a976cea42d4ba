"""The pipeline on odd rows, stage by stage and whole."""

import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
from graphloom.llm import common, queries

from .test_operators import words

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, times int, copy string, k string"


def fixture(spark, folder):
    item = " ".join(words(60, 900))
    clean = [(i, " ".join(words(50 + i % 7, i)), "en", f"s{i % 3}") for i in range(120)]
    copies = [(200 + i, clean[i][1], "en", "s1") for i in range(5)]
    near = [(300, clean[7][1] + " more", "de", "s2")]
    toxic = [(400 + i, " ".join(words(30, 400 + i)) + " you idiot moron scum", "en", "s0") for i in range(60)]
    leaks = [(500, "so " + item + " end", "en", "s1")]
    odd = [(600, None, None, None), (601, "", "en", "s0"), (None, "a null id here", None, "s2"), (602, "twice the same", "en", "s0"), (602, "twice the same", "fr", "s1"), (603, " ".join(words(20_000, 5)), "en", None)]
    rows = [(i, t, g, s, None if t is None else len(t), 1, "c", "k") for i, t, g, s in [*clean, *copies, *near, *toxic, *leaks, *odd]]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 400)) for i in [*range(120), *range(400, 460)]], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_on_odd_rows(spark, tmp_path):
    d = str(tmp_path)
    rows = fixture(spark, d)
    docs, before = spark.read.parquet(f"{d}/documents.parquet"), Counter(r[0] for r in rows)
    gone = {"toxicity": set(range(400, 460)), "near_dedup": {200, 201, 202, 203, 204, 300}, "decontamination": {500}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "mixing":
            assert set(ids) <= set(before) - {600, 601} and max(ids.values()) <= 3
        else:
            assert set(before) - set(ids) == gone[name], name
            assert ids[602] == (2 if name == "toxicity" else 1) and {600, 601, 603, None} <= set(ids)
            before = ids
    mixed = docs.collect()
    index = corpus_pipeline.STAGES[-1][1](spark, docs, d).orderBy("start").collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in index) == want
    assert [r["start"] for r in index] == [sum(r["n_tokens"] for r in index[:i]) for i in range(len(index))]


def test_run_is_the_stages_and_leaves_no_tables(spark, tmp_path):
    d = str(tmp_path)
    fixture(spark, d)
    shared = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    got = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=repr)
    assert got == sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=repr) and got
    names = {re.sub("-[0-9a-f]{32}$", "", p.name) for p in set(shared.iterdir()) - before}
    assert names <= {"token-files", "mixing"}


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    for name, kind in (("documents", COLUMNS), ("labels", "doc_id bigint, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
