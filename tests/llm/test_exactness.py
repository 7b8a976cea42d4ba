"""The operators' own methods against plain versions, and rows that collide, repeat or are hot."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, decontamination, elias_fano, license_scan, lm_scoring, mixing, near_dedup, queries, secret_scan, token_output, topk_search, toxicity, url_filter

from .test_operators import brute_components, words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# shared tables


def test_scratch_keeps_what_is_kept(spark):
    with common.scratch(spark):
        gone = common.stage(spark.range(3), "gone")
        with common.scratch(spark):
            inner = common.kept(common.stage(spark.range(4), "inner"))
            by = common.stage_by(spark.range(5).withColumnRenamed("id", "k"), "by", "k", 2)
            assert by.count() == 5
        assert inner.count() == 4
        left = common.kept(common.stage(gone.union(inner), "left"))
    assert left.count() == 7
    for df in (gone, inner, by):
        with pytest.raises(Exception):
            spark.read.parquet(df._staged_at).count()


def test_keyed_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "fits_broadcast", lambda df, *_: False)
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 20 + ["a", "b", None, None])], "k string, i int")
    side = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, v int")
    got = {r.i: r.v for r in common.keyed_join(left, side, "k").collect()}
    assert got == {i: 1 if i < 20 else 2 if i == 20 else None for i in range(24)}


def test_broadcasts_are_checked_by_bytes(spark):
    df = spark.range(100).select(F.array_repeat(F.lit(1).cast("long"), 1000).alias("a"))
    assert common.fits_broadcast(df, 100, 10**6) and not common.fits_broadcast(df, 100, 10**5) and not common.fits_broadcast(df, 99, 10**6)


# 1 mixing


def test_mixed_documents_match_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), f"s{i % 3}", "x", 1) for i in range(200)] + [(None, "null id one", "s0", "x", 1), (None, "null id two", "s1", "x", 1), (7, None, None, "x", 1), (8, "", "s1", "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, times string, copy int")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        if r["size"]:
            taken[r["doc_id"], r["size"]] += r["taken"] // r["size"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in out.collect())
    assert got == Counter({k: v for k, v in taken.items() if v})
    assert sorted(out.collect(), key=repr) == sorted(mixing.mixed(docs.repartition(7)).collect(), key=repr)


def test_mixing_with_sources_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), f"s{i % 3}" if i % 11 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    usual = sorted(mixing.mix(docs).collect(), key=repr)
    monkeypatch.setattr(mixing, "fits_broadcast", lambda *_: False)
    assert sorted(mixing.mix(docs).collect(), key=repr) == usual


# 2 toxicity


def test_isotonic_is_the_least_squares_fit():
    r = np.random.default_rng(0)
    score, y = r.permutation(12).astype(float), (r.random(12) < 0.5).astype(float)
    xs, ys = toxicity.isotonic(score, y)
    fitted = np.interp(score[np.argsort(score)], xs, ys)
    y = y[np.argsort(score)]
    plain = [max(min(y[i : k + 1].mean() for k in range(j, 12)) for i in range(j + 1)) for j in range(12)]  # max-min formula
    assert np.allclose(fitted, plain) and (np.diff(fitted) >= 0).all()


def test_trees_against_a_plain_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(float)
    model = toxicity.fit_trees(x, y, rounds=8, depth=2)

    def walk(row):
        total = model.base
        for feature, cut, leaf in model.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(model.raw(x), [walk(row) for row in x])
    stump = toxicity.fit_trees(x, y, rounds=1, depth=1, rate=1.0)
    feature, cut, leaf = stump.trees[0]
    p = y.mean()
    best = 0.0
    for j in range(3):
        for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])):
            g = [(p - y[side]).sum() for side in (x[:, j] <= edge, x[:, j] > edge)]
            h = [side.sum() * p * (1 - p) + 1 for side in (x[:, j] <= edge, x[:, j] > edge)]
            best = max(best, sum(a * a / b for a, b in zip(g, h)))
    sides = x[:, feature[0]] <= cut[0], x[:, feature[0]] > cut[0]
    assert math.isclose(best, sum((p - y[s]).sum() ** 2 / (s.sum() * p * (1 - p) + 1) for s in sides), rel_tol=1e-9)
    assert np.allclose(leaf, [-(p - y[s]).sum() / (s.sum() * p * (1 - p) + 1) for s in sides])


def test_toxicity_odd_rows(spark):
    rows = [(i, " ".join(words(30, i)) + (" you idiot scum" if i % 4 == 0 else ""), "x", 0.5) for i in range(200)]
    docs = spark.createDataFrame([*rows, (3, rows[3][1], "y", 0.1), (None, None, None, None)], "doc_id bigint, text string, y string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (8, 1, 0)], "doc_id bigint, toxic int, text int")
    got = toxicity.score(docs, labels).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(got) == 202 and all(len(s) == 1 for s in by.values())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in by if max(by[i]) < 0.5}
    few = toxicity.train(docs, labels, max_rows=50)
    assert few.knots is not None and toxicity.train(docs, labels, max_bytes=100).knots is None


# 3 token files


def test_pieces_are_bounded():
    e = token_output.PieceEncoder(queries.tokenizer_path())
    e.encode(["x" * 5000 + " " + "y" * 100 + " short"], 2)
    assert all(len(k) <= token_output.KEPT_CHARS for table in (e.whole, e.bare, e.spaced) for k in table)


def test_words_are_asked_for_once(monkeypatch):
    """Of a word in many guises, and of a frequent one between rare ones that fill the table, the library is asked once."""
    e = token_output.PieceEncoder(queries.tokenizer_path())
    asked, learn = Counter(), e.spaced.learn
    monkeypatch.setattr(e.spaced, "learn", lambda got: asked.update([got] if isinstance(got, str) else got) or learn(got))
    monkeypatch.setattr(token_output, "KEPT_PIECES", 20)
    texts = [f"a usual, usual. usual;\nusual {'abcdefghijklmnopqrst'[i // 20]}{'abcdefghijklmnopqrst'[i % 20]}q" for i in range(400)]
    for i in range(0, 400, 8):
        e.encode(texts[i : i + 8], 2)
    assert sum(n for p, n in asked.items() if "usual" in p) <= 2
    assert len(list(e.spaced)) <= 20


def test_parts_are_exact_in_any_company():
    r = random.Random(5)
    bits = [*"abzQ  \n\t\r\x0b'_-.,19é٣²½Ⅷ一\u0301\u200d\xa0\x85\x1c\u3000\x00\U0001f600ǅªº", "'s", "'re", " it's", "<|endoftext|>", "  ", "\n\n", "word", " foo", "x" * 70]
    e = token_output.PieceEncoder(queries.tokenizer_path())
    for _ in range(40):
        some = r.sample(bits, r.randint(2, len(bits)))
        texts = ["".join(r.choices(some, k=r.randint(0, 30))) for _ in range(20)]
        for text, got in zip(texts, e.encode(texts, 2), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)


# 4 top-k


@pytest.mark.parametrize("clustered", [False, True])
def test_topk_prunes_nothing_it_needs(spark, clustered):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 20))
    if clustered:
        x = x * 0.05 + r.normal(size=(4, 20))[np.arange(900) % 4] * 3
    x[::30] = x[0]  # one vector, many times
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, id string, v int")
    got = {}
    for g in topk_search.top_k(df, query_block=7, row_block=60).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    q = np.floor(64 * x).astype(int)
    for i in range(0, 900, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(900) if j != i)[:20]
        assert sorted(got.pop(i)) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert not got


def test_topk_repeated_ids_and_large_numbers(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [5.0, 0.0]), (21, [1e7, 1e7]), (22, [3e7, -1e7]), (23, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df).collect())
    q = [np.floor(64 * np.array(v)).astype(object) for _, v in rows]
    one = sorted((-(int(q[0][0]) * int(q[j][0]) + int(q[0][1]) * int(q[j][1])), rows[j][0]) for j in (3, 4, 5))
    two = sorted((-(int(q[2][0]) * int(q[j][0])), rows[j][0]) for j in (3, 4, 5))
    assert got == sorted((20, n + 1, i, -s) for best in (one, two) for n, (s, i) in enumerate(best))


# 5 decontamination and 7 licenses: all windows by brute force


def shingle_set(ws, size=5):
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)}


def edited(r, ws, changes):
    out = list(ws)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def test_decontamination_brute_force(spark):
    r = random.Random(3)
    common_words = words(25, 99)  # a prompt that half of the items begin with
    items = {i: [*(common_words if i % 2 else []), *words(60, 200 + i)] for i in range(12)}
    docs, truth = {}, set()
    for d in range(80):
        i = r.randrange(12)
        own = edited(r, items[i], r.choice([0, 1, 1, 2, 3, 6]))
        docs[d] = [*words(r.randrange(5, 60), 500 + d), *own, *words(r.randrange(5, 60), 900 + d)]
        docs[d] += common_words if d % 3 == 0 else []
    weights = Counter(s for ws in items.values() for s in shingle_set(ws))
    for d, ws in docs.items():
        for i, own in items.items():
            have, n = shingle_set(own), len(own)
            for at in range(len(ws) - n + 1):
                window = shingle_set(ws[at : at + n])
                both, every = have & window, have | window
                if not both:
                    continue
                weigh = lambda s: sum(1 / weights.get(x, 1) for x in s)
                if len(both) >= 0.8 * len(every) or weigh(both) >= 0.8 * weigh(every) - 1e-9:
                    truth.add((d, i))
                    break
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(texts_of(spark, [(d, " ".join(ws)) for d, ws in docs.items()]), bench).collect()}
    assert got <= truth and len(got) >= 0.95 * len(truth) > 30


def test_license_brute_force_recall(spark):
    r = random.Random(4)
    template = words(70, 77)
    docs, truth = {}, set()
    for d in range(120):
        own = edited(r, template, r.choice([0, 1, 2, 2, 3, 4]))
        docs[d] = [*words(30, 300 + d), *own, *words(30, 600 + d)]
        if len(shingle_set(own) & shingle_set(template)) >= 0.8 * len(shingle_set(template)):
            truth.add(d)
    known = spark.createDataFrame([("L", " ".join(template))], "license string, text string")
    got = {x["doc_id"] for x in license_scan.scan(texts_of(spark, [(d, " ".join(ws)) for d, ws in docs.items()]), known).collect()}
    assert truth <= got and len(truth) > 40
    for d in got - truth:  # the window that is verified is wider than the template
        assert len(shingle_set(docs[d]) & shingle_set(template)) >= 0.8 * len(shingle_set(template))


def test_retrieval_and_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six", "x"), (1, "one two three four five six", "y"), (2, None, "x"), (3, "", "x"), (None, "alpha beta", "x")], "item_id bigint, text string, k string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven", 1), (1, "zero one two three four five six seven", 1), (None, "so alpha beta", 1), (4, None, 1), (5, "", 1)], "doc_id bigint, text string, pid int")
    got = sorted(((x["doc_id"], x["item_id"], x["similarity"]) for x in decontamination.contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 1, 1.0)] * 4 + [(None, None, 1.0)], key=repr)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [4, 5]
    templates = license_scan.template_table(spark)
    twice = spark.createDataFrame([(1, "x y\nAll rights reserved.", 1)] * 2, "doc_id bigint, text string, license int")
    assert [(x["doc_id"], x["license"]) for x in license_scan.scan(twice, templates).collect()] == [(1, "Proprietary")] * 2
    assert license_scan.scan(twice.limit(0), templates).collect() == license_scan.scan(twice, templates.limit(0)).collect() == []


# 6 secrets


def plain_base(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", secret_scan.ASSIGN, 2, 8), ("access", secret_scan.ACCESS, 0, 16), ("hex", secret_scan.HEX, 0, 32))):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_against_plain_scan_and_owners(spark):
    import hashlib

    r = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    live, copied = ("".join(r.choice(chars) for _ in range(44)) + "aA1" for _ in range(2))
    token = "ghp_" + "".join(r.choice(chars) for _ in range(36))
    bits = ["password = ", "Token:'", "api_key\": \"", "AKIA", "deadbeef" * 4, "ABCD1234ABCD1234", " é ", "x" * 9, "=", "secret:", "\n", live[:12], "AKIAAKIA"]
    rows = [(i, "".join(r.choice(bits) for _ in range(12)), f"s{i % 4}", "en") for i in range(150)]
    rows += [(1000 + i, f"see {copied} and {token} here", f"s{i}", "en") for i in range(4)] + [(2000, f"mine {live} !", "s0", "en"), (2000, f"mine {live} !", "s0", "en"), (None, None, None, None), (2002, "", None, None), (2003, f"{token[:-1]}Z alone", "s1", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("spans", F.lit(1)).withColumn("row", F.lit(2))
    got = secret_scan.scan_digest(docs).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for i, text, *_ in rows[:150]:
        base = plain_base(text)
        assert by[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and (by[i]["n_assign"], by[i]["n_access"], by[i]["n_hex"]) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))
        assert set(base.split(",")) - {""} <= set(by[i]["spans"].split(","))
    assert [by[1000 + i]["spans"] for i in range(4)] == [""] * 4  # four owners have both values: an example
    assert by[2000]["spans"] == "opaque:5:52" and by[2000]["n_live"] == 1 and by[2003]["spans"] == "prefixed:0:40"
    assert by[None]["spans"] == by[2002]["spans"] == ""
    assert secret_scan.scan_digest(docs.limit(0)).collect() == []


def test_span_cover_against_all_pairs():
    r = random.Random(6)
    for _ in range(300):
        spans = [(a, a + r.randrange(1, 9)) for a in (r.randrange(40) for _ in range(r.randrange(6)))]
        cover, a = secret_scan._Cover(spans), r.randrange(40)
        b = a + r.randrange(1, 9)
        assert cover.holds(a, b) == any(s <= a and b <= e for s, e in spans)
        assert cover.meets(a, b) == any(s < b and e > a for s, e in spans)


def test_many_spans_in_one_text_stay_linear():
    import time

    text = " ".join(f"password=abcdefgh{i} {'Ab1' * 11}{i:05d}" for i in range(20_000))
    began = time.time()
    secret_scan.added_spans(text, secret_scan.base_spans(text))
    assert time.time() - began < 5


# 8 near-duplicates


def test_digest_collisions_are_told_apart(spark):
    """With digests of one byte most classes hold different sets; the full sets tell them apart."""
    texts = {i: " ".join(words(12, i)) for i in range(300)}
    for i in range(0, 60, 2):
        texts[1000 + i] = texts[i]
    df = texts_of(spark, sorted(texts.items()))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, size=3, percent=85, digest_bytes=1).collect()}
    assert got == brute_components(texts, 3, 85)


def test_repeated_rows_are_dropped_alike(spark):
    rows = [(1, "a b c d e f", "x", 2), (1, "a b c d e f", "y", 1), (1, "a b c d e f", "x", 1), (2, "a b c d e f", "z", 9), (3, None, "b", 1), (3, None, "a", 1), (4, "", "q", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string, kept int")
    results = [sorted(map(tuple, near_dedup.drop_near_duplicates(df.repartition(n)).collect()), key=repr) for n in (1, 5)]
    assert results[0] == results[1] == sorted([(1, "a b c d e f", "x", 1), (3, None, "a", 1), (4, "", "q", 1)], key=repr)


# 9 language model


def plain_scores(rows, folds=10):
    uni, pair, texts = Counter(), Counter(), []
    for i, text in rows:
        t = [*(w.lower() for w in WORD.findall(text or "")), None]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0
        texts.append((i, held, t))
        if not held:
            uni.update(t)
            pair.update(zip([None, *t], t))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    score = lambda a, b: math.log10((pair[a, b] + lm_scoring.MU * p1(b)) / (uni[a] + lm_scoring.MU))
    return [(i, held, len(t), sum(w in uni for w in t), n, sum(math.log10(p1(w)) for w in t), sum(score(a, b) for a, b in zip([None, *t], t))) for i, held, t in texts]


@pytest.mark.parametrize("shard_tokens", [1_500_000, 40])
def test_lm_scores_brute_force(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", shard_tokens)
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("a b c the The of x y z w1 w2 w3 w4".split()) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    rows += [(3, rows[3][1]), (None, "null a"), (500, None), (501, "never seen é words"), (502, " ".join(f"u{i}" for i in range(3000)))]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, held int")
    got = sorted(map(tuple, lm_scoring.score_texts(docs).collect()), key=repr)
    for g, e in zip(got, sorted(plain_scores(rows), key=repr), strict=True):
        assert g[:5] == e[:5] and abs(g[5] - e[5]) < 1e-8 * max(1, abs(e[5])) and abs(g[6] - e[6]) <= 2.6e-4 * e[2]


def test_trie_is_searched_between_pointers():
    r = np.random.default_rng(8)
    contexts = np.sort(r.integers(0, 50, 4000))
    words_ = r.integers(0, 1 << 33, 4000)
    order = np.lexsort((words_, contexts))
    contexts, words_ = contexts[order], words_[order]
    trie = elias_fano.Trie(contexts, words_, -r.random(4000))
    log = trie.log10(contexts, words_)
    assert not np.isnan(log).any()
    other = np.roll(words_, 1)  # words of a neighbour: only there if the context has them too
    known = {*zip(contexts.tolist(), words_.tolist())}
    assert (np.isnan(trie.log10(contexts, other)) == [(c, w) not in known for c, w in zip(contexts.tolist(), other.tolist())]).all()
    for c in (0, 17, 49):
        assert trie.followers(c).tolist() == sorted(words_[contexts == c].tolist())
    assert len(trie.followers(99)) == 0 and np.isnan(trie.log10(np.array([99]), np.array([1])))[0]
    with_context = trie.level2.successor(words_[:1], 5, np.array([5]))
    assert not with_context[1][0]


# 10 URL filter


def test_false_positives_are_removed(spark, monkeypatch):
    """A filter of one block and many URLs lets almost everything pass; the exact join decides."""
    monkeypatch.setattr(url_filter, "_PER_BLOCK", 10**9)
    listed = spark.createDataFrame([(f"http://l{i}.net/a",) for i in range(600)], "url string")
    pages = spark.createDataFrame([(i, f"http://{'l' if i % 2 else 'p'}{i}.net/a", "x", True) for i in range(400)] * 2 + [(None, None, "x", True), (1000, "nothing", "x", True)], "page_id bigint, url string, host string, listed boolean")
    table = url_filter.bloom(listed.select(url_filter.canonical(F.col("url")).alias("url")), 1)
    assert table.count() == 1 and all(bin(v & (2**64 - 1)).count("1") > 60 for k, v in table.first().asDict().items() if k != "block")
    got = [(r["page_id"], r["verdict"]) for r in url_filter.judge(pages, listed).collect()]
    assert len(got) == 802 and {i for i, v in got if v == "block"} == {i for i in range(400) if i % 2}
    monkeypatch.setattr(url_filter, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(common, "fits_broadcast", lambda *_: False)
    assert sorted(map(tuple, url_filter.judge(pages, listed).select("page_id", "verdict").collect()), key=repr) == sorted(got, key=repr)
    assert url_filter.judge(pages.limit(0), listed).collect() == []
