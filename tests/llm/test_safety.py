"""Near twins among licenses, ids of other types, small weights, labels that teach nothing, and queries side by side."""

import random
import threading

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import common, license_scan, mixing, near_dedup, secret_scan, toxicity

from .test_operators import words


def test_every_license_is_told_from_every_other(spark):
    noise = lambda i, n: " ".join(words(n, i))
    docs = [(i, f"{noise(i, 40)} {text} {noise(100 + i, 40)}") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(docs, "doc_id int, text string"), license_scan.template_table(spark)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {i: {name} for i, (name, _) in enumerate(license_scan.TEMPLATES)}


def test_license_twins_and_neighbours(spark):
    texts = dict(zip([f"{n}:{i}" for i, (n, _) in enumerate(license_scan.TEMPLATES)], [t for _, t in license_scan.TEMPLATES], strict=True))
    pick = lambda name: max((t for k, t in texts.items() if k.startswith(f"{name}:")), key=len)
    gpl3, two, three = pick("GPL-3.0"), pick("BSD-2-Clause"), pick("BSD-3-Clause")
    gap = " ".join(words(200, 5))
    docs = [
        (1, gpl3.replace("version 3 of", "of").replace("either", "")),  # a version that nobody named
        (2, f"{three} {gap} {two}"),
        (3, f"{two} {gap} {three}"),
        (4, f"{gpl3} {pick('GPL-2.0')}"),
        (5, two.replace("distribution", "package", 1)),
        (6, " ".join([pick("MIT")] * 300)),
    ]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), license_scan.template_table(spark)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {2: {"BSD-2-Clause", "BSD-3-Clause"}, 3: {"BSD-2-Clause", "BSD-3-Clause"}, 4: {"GPL-2.0", "GPL-3.0"}, 5: {"BSD-2-Clause"}, 6: {"MIT"}}


@pytest.mark.parametrize("kind", ["int", "smallint", "string"])
def test_ids_of_other_types(spark, kind):
    rows = spark.createDataFrame([(i, " ".join(words(30, i // 2)) + " token=abcdefgh1234", "s", "en") for i in range(10)], "doc_id bigint, text string, source string, lang string")
    docs = rows.withColumn("doc_id", F.col("doc_id").cast(kind))
    assert {r.doc_id: r.n_assign for r in secret_scan.scan_digest(docs).collect()} == dict.fromkeys(range(10), 1)
    assert {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()} == {0, 2, 4, 6, 8}
    assert near_dedup.drop_near_duplicates(docs).count() == 5


def test_copies_of_texts_with_equal_sets(spark):
    """One set, three texts, many copies: still one class, whatever the digest; and a shorter digest parts none that differ."""
    a = " ".join(words(40, 1))
    rows = [(i, (a, a.upper(), a.replace(" ", "\t"))[i % 3]) for i in range(60)] + [(100 + i, " ".join(words(40, 2 + i % 5))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for digest in (16, 1):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, digest_bytes=digest).collect()}
        assert got == {i: 0 if i < 60 else 100 + (i - 100) % 5 for i, _ in rows}


def test_small_weights_keep_their_order(spark):
    """Weights so small that u ** (1 / w) is 0 for half of the documents: the mix still follows -ln(u) / w, not the ids."""
    docs = spark.createDataFrame([(i, "one two", "a" if i < 3000 else "b", 1e-4) for i in range(6000)], "doc_id bigint, text string, source string, q double")
    got = mixing.mix(docs, quality_col="q", weights=(5, 1)).where("source = 'b'").select("doc_id", "taken").collect()
    taken = {r.doc_id for r in got if r.taken}
    key = mixing.sampling_key("mix-1", F.col("doc_id").cast("string"), F.col("q"))
    order = [r.doc_id for r in docs.where("source = 'b'").select("doc_id", key.alias("key")).orderBy("key", "doc_id").collect()]
    assert 0 < len(taken) < 3000 and taken == set(order[: len(taken)])
    low = sum(i < 4500 for i in taken) / len(taken)
    assert 0.4 < low < 0.6
    bins = docs.select(mixing._bin(key).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert bins < 100


def test_labels_that_teach_nothing_drop_nothing(spark):
    docs = spark.createDataFrame([(i, " ".join(words(20, i))) for i in range(50)] + [(50, None), (51, "")], "doc_id bigint, text string")
    for labels in ([(i, 1) for i in range(7)], [(i, 1) for i in range(50)], [(i, 0) for i in range(50)], []):
        table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
        assert toxicity.drop_toxic(docs, table).count() == 52
        assert len({r.score for r in toxicity.score(docs, table).collect()}) == 1
    mostly = spark.createDataFrame([(i, int(i > 3)) for i in range(50)], "doc_id bigint, toxic int")
    assert {r.doc_id for r in toxicity.drop_toxic(docs, mostly).collect()} >= {50, 51}


def test_scratches_of_two_threads(spark):
    begun, ended = threading.Barrier(2), threading.Event()
    seen, failed = [], []

    def first():
        with common.scratch(spark):
            common.stage(spark.range(3), "mine")
            begun.wait(60)
        ended.set()

    def second():
        try:
            with common.scratch(spark):
                table = common.stage(spark.range(4), "yours")
                begun.wait(60)
                ended.wait(60)
                seen.append(table.count())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=f) for f in (first, second)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen == [4] and not failed


def test_operators_side_by_side(spark):
    draw = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(words(30, draw.randrange(20)))) for i in range(60)], "doc_id bigint, text string")
    alone = sorted(map(str, near_dedup.near_duplicates(docs).drop("k").collect()))
    got = []
    threads = [threading.Thread(target=lambda: got.append(sorted(map(str, near_dedup.near_duplicates(docs).drop("k").collect())))) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [alone, alone]


def test_results_can_be_released(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    found = near_dedup.near_duplicates(docs)
    assert found.count() == 2
    common.release()
    with pytest.raises(Exception):
        spark.read.parquet(found._staged_at).count()


def test_texts_without_words_pass_the_pipeline_up_to_the_mix(spark):
    docs = spark.createDataFrame([(i, " ".join(words(30, i)), "en", "s", 1) for i in range(30)] + [(30, None, "en", "s", 0), (31, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001"), "/root/testdata/sf0.001")
    assert {r.doc_id for r in docs.collect()} >= {30, 31}
