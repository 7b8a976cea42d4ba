"""Language identification, embedding whitening and importance resampling: plain versions, SQL and odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import language_id, queries, resampling, whitening

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, grp string, slice string, bucket string, k string, rank string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "g", "l", "b", "k", "r") for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_language_id", "op13_importance_resampling", "embedding_deviations"])
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        path = f"{DIR}/{t}.parquet"
        duck.sql(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    df, rel = queries.QUERIES[name](spark, DIR), duck.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(map(str, ([r[c] for c in cols] for r in df.collect()))) == sorted(map(str, ([r[i] for i in at] for r in rel.fetchall())))


# 11 language identification


def plain_grams(text):
    out = Counter()
    for word in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split():
        p = f" {word} "
        out.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    return out


def plain_ranks(counts, size):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:size])}


def plain_judge(rows, size, own):
    known = {}
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 3 != 1:
            known.setdefault(lang, Counter()).update(plain_grams(t))
    known = {lang: plain_ranks(c, size) for lang, c in known.items() if c}
    out = []
    for i, t, _ in rows:
        mine = plain_ranks(plain_grams(t), own)
        far = [(sum(abs(r - p[g]) if g in p else size for g, r in mine.items()), lang) for lang, p in sorted(known.items())]
        best = min(far) if mine and far else None
        out.append((i, best[1] if best else "und", 1 - best[0] / (size * len(mine)) if best else 0.0))
    return out


def invented(seed, alphabet, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(n))


def test_language_id_against_plain(spark):
    rows = [(i, invented(i, ("aeioust", "äöüßchen", "яблоку", "漢字仮名𠀀")[i % 4], 1 + i % 30), ("en", "de", "ru", None)[i % 4]) for i in range(60)]
    rows += [(60, None, "en"), (61, "", "de"), (62, "12 34 !!", "en"), (63, "İstanbul ǅ ΑΒΓ Straße", "tr"), (None, "aeiou", "en"), (7, "aeiou", "en"), (7, "aeiou", "en")]
    for size, own in ((20, 10), (language_id.PROFILE, language_id.OWN)):
        got = language_id.identify_held_out(texts(spark, rows), profile=size, own=own).collect()
        assert sorted(((r.doc_id, r.lang_pred, round(r.score, 12)) for r in got), key=str) == sorted(((i, p, round(s, 12)) for i, p, s in plain_judge(rows, size, own)), key=str)
    assert {r.doc_id: r.held_out for r in got}[7] == (zlib.crc32(b"7") % 3 == 1)


def test_language_id_of_parts_and_wide_alphabets(monkeypatch):
    whole = [invented(1, "abcdé", 300), "", None, invented(2, [chr(c) for c in range(0x4E00, 0x4E80)], 200)]
    expected = language_id.grams(whole)
    plain = {(i, g): c for i, t in enumerate(whole) for g, c in plain_grams(t).items()}
    spelled = lambda g: "".join(chr(p) for p in (g >> 42, g >> 21 & (1 << 21) - 1, g & (1 << 21) - 1) if p)
    assert {(int(o), spelled(int(g))): int(c) for o, g, c in zip(*expected, strict=True)} == plain
    monkeypatch.setattr(language_id, "_PART", 7)
    for a, b in zip(language_id.grams(whole), expected, strict=True):
        assert (a == b).all()


def test_language_id_without_anything_to_learn(spark):
    got = language_id.identify_held_out(texts(spark, [(0, "abc", None), (1, "123", "en")])).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(0, "und", 0.0), (1, "und", 0.0)}
    assert language_id.identify_held_out(texts(spark, [(0, "a", "en")]).limit(0)).collect() == []


def test_language_id_accuracy(spark):
    got = queries.op11_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    met = got.where("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred)) as right").first()
    assert met.right > 0.98


# 12 whitening


def test_jacobi_small_eigenvalues():
    for n in (1, 2, 3, 8, 17):
        r = np.random.default_rng(n)
        q, _ = np.linalg.qr(r.normal(size=(n, n)))
        a = q @ np.diag(10.0 ** np.arange(0, -n, -1.0)[:n] if n < 9 else np.linspace(1, 5, n)) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-8, atol=1e-15)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-13 * max(1, values[0])
    assert (whitening.jacobi(np.zeros((3, 3)))[0] == 0).all()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id int, embedding array<float>, x string, n int")


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r.normal(size=5) * (1, 2, 3, 4, 0.5)]) for i in range(400)]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1.0, 2.0])]
    repeats = [(None, rows[0][1]), (1, rows[1][1])] + [(1000 + i, rows[2][1]) for i in range(200)]
    got = whitening.whiten(vectors(spark, rows + odd + repeats), 4).collect()
    kept = [(i, v) for i, v in rows + repeats]
    assert sorted(str(g.vec_id) for g in got) == sorted(str(i) for i, _ in kept)
    x = np.floor(256 * np.array([np.float32(v) for _, v in kept], float))
    fit = np.unique(x, axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    plain = {tuple(v): ((v - fit.mean(0)) @ basis[:, :4] / np.sqrt(values[:4]), int(((len(fit) * v - fit.sum(0)) ** 2).sum())) for v in x}
    for g in got:
        own = x[[i for i, _ in kept].index(g.vec_id)]
        white, deviation = plain[tuple(own)]
        assert g.n == len(fit) and g.deviation == deviation and g.identity_error < 1e-9
        assert np.allclose(np.abs(g.whitened), np.abs(white), atol=1e-9) and np.allclose(g.explained, values[:4] / values.sum(), rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    (one,) = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [None, None], [None, None], None)
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(4)])).collect()
    assert all(g.whitened[1] is None and abs(g.explained[0] - 1) < 1e-12 for g in flat)
    wide = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {g.vec_id: g.deviation is None for g in wide} == {1: True, 2: True, 3: False} and all(math.isfinite(g.whitened[0]) for g in wide)


def test_exact_products_do_not_depend_on_batches():
    import pyarrow as pa

    r = np.random.default_rng(1)
    for size in (100, 1 << 30, 1 << 60):
        x = r.integers(-size, size, (50, 3))
        centre = np.array([int(v) for v in x.mean(0)], object)
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array(part.tolist(), pa.list_(pa.int64()))], names=["x"])
        (got,) = whitening._products(3, centre)(iter([batch(x[:20]), batch(x[20:])]))
        d = x.astype(object) - centre
        assert (got == d.T @ d).all()


# 13 resampling

RUN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def plain_features(text):
    ws = RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return ws, ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def plain_resample(docs, target):
    s, t = (Counter(bucket(f) for x in side for f in plain_features(x)[1]) for side in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, x in docs:
        ws, fs = plain_features(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(ws)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in rows]


def test_resampling_against_plain(spark):
    docs = [(i, invented(i, "abcDEé9", 5 + i * 2)) for i in range(50)] + [(50, None), (51, ""), (52, ".,;"), (53, "one"), (None, invented(3, "xyz", 40)), (4, invented(4, "abcDEé9", 13))]
    docs += [(60, "word " * 30_000), (61, "x" * 5_000 + " " + "y" * 70 + " z"), (62, "tab\tnew\nline\x00nul 漢字，仮名 ok " * 8)] + [(70 + i, "the same text again and again " * 6) for i in range(40)]
    target = [invented(100 + i, "abcxé", 30) for i in range(5)] + [None, ""]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, s int")
    got = resampling.resample(texts(spark, [(i, t, None) for i, t in docs]), table).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=str) == sorted(plain_resample(docs, target), key=str)
    none = resampling.resample(texts(spark, [(i, t, None) for i, t in docs[:30]]), table.limit(0)).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in none), key=str) == sorted(plain_resample(docs[:30], []), key=str)
    assert resampling.resample(texts(spark, [(1, "a", None)]).limit(0), table).collect() == []


def test_resampling_of_parts(monkeypatch):
    text = invented(9, "abcé ", 4_000).encode() + b" " + b"q" * 500 + b" tail" + b"." * 300 + b" end"
    raw = np.frombuffer(text, np.uint8)
    expected = Counter(bucket(f) for f in plain_features(text.decode())[1])
    for part in (16, 100, 1 << 20):
        monkeypatch.setattr(resampling, "_PART", part)
        counts, n = resampling._long_text(raw, 10_000)
        assert n == len(plain_features(text.decode())[0]) and {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == expected


def test_drawn_documents(spark):
    rows = [(i, invented(i, "abcd", 30), "en") for i in range(40)] + [(7, invented(7, "abcd", 30), "en")] * 6
    docs = texts(spark, rows)
    target = spark.createDataFrame([(rows[7][1],)], "text string")
    ranks = [r for r in resampling.resample(docs, target).collect() if r.rank is not None]
    got = resampling.drawn(docs, target)
    assert got.columns == docs.columns and sorted(r.rank for r in ranks) == list(range(1, 12))
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in ranks)
