"""Suffix removal, whitening and ranked search against brute force, on small, odd, repeated and empty tables."""

import heapq
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark.llm import langid, lexical, licences, queries, suffixes, whitening

CLASH = ("t", "n", "doc", "k", "score", "rank", "query", "terms", "whitened", "component", "body", "id")


def clashing(df):
    """The table with columns named as inner ones."""
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def sql_rows(spark, sf, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetchall()


# --- repeated byte strings -----------------------------------------------------------------


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def planted(seed=1):
    """Small texts over few words with shared passages, copies, runs and equal ids."""
    rng = random.Random(seed)
    pool = ["ab", "abc", "é", "漢字", "x", "lorem", "ipsum", "dolor"]
    passages = [words(rng, 30, pool) for _ in range(4)]
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(0, 40), pool)
        if rng.random() < 0.6:
            text += rng.choice(["", " ", "é"]) + rng.choice(passages)[rng.randint(0, 20) :] + words(rng, rng.randint(0, 9), pool)
        rows.append((i if i % 7 else i // 2, text))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 9)] + [(None, rows[3][1]), (None, None), (70, ""), rows[5], rows[5]]
    return rows + [(200, "a" * 400), (201, "b" * 60 + "a" * 120), (200, "a" * 55), (202, "a" * 49), (-5, passages[0]), (203, "a" * 400)]


def removed(df, **args):
    got = suffixes.without_repeats(df, digest=True, **args).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) for r in got)


def expected(rows, width=50):
    found = suffixes.brute_force(rows, width)
    return sorted((d is None, d or 0, *x) for (d, _), x in zip(rows, found))


def test_suffix_removal_equals_brute_force(spark):
    for seed in (1, 2, 3):
        rows = planted(seed)
        df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert removed(df) == expected(rows)


def test_suffix_removal_with_common_pairs_and_segments(spark, monkeypatch):
    """Common rank pairs are dealt out string by string, long texts are worked on in segments: the same rows."""
    monkeypatch.setattr(suffixes, "COMMON_HERE", 2)
    monkeypatch.setattr(suffixes, "COMMON_ROWS", 2)
    rows = planted(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    body = F.coalesce("text", F.lit("")).cast("binary")
    common = suffixes.common_pairs(df.select(body.alias("body")), 50)
    assert len(common) > 50
    assert removed(df) == expected(rows)
    found = [s for s in suffixes.sliced([b"xy" * 900_000], 50)]
    assert [len(s.buffer) for s in found] == [suffixes.SEGMENT + 49, 1_800_000 - suffixes.SEGMENT]
    assert sum(int((s.high - s.low + 1).sum()) for s in found) == 1_800_000 - 49


def test_suffix_removal_of_long_texts(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh ") for _ in range(suffixes.SEGMENT + 5_000))
    cut = suffixes.SEGMENT - 30
    rows = [(1, base), (2, "zz" + base[cut : cut + 300] + "yy"), (3, base[5_000:])]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(x[1], x[3], x[4]) for x in got] == [(1, 0, 0), (2, 300, 1), (3, len(base) - 5_000, 1)]


def test_equal_names_of_different_strings_are_told_apart(monkeypatch):
    """If all names collide, the strings themselves decide."""
    real = suffixes.ranked
    monkeypatch.setattr(suffixes, "ranked", lambda b, width=50: (real(b, width)[0], np.zeros(len(b), np.uint64)))
    raw = [b"a" * 52, b"a" * 50 + b"bb", b"c" * 50]
    of, gone = suffixes.compared(raw, np.array([1, 2, 3]), 50)
    assert list(zip(of.tolist(), gone.tolist())) == [(0, False)] * 3 + [(1, True), (1, False), (1, False), (2, False)]


def test_suffix_removal_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeat_digests(empty).collect() == []
    short = spark.createDataFrame([(1, "short"), (1, "short"), (2, None)], "doc_id long, text string")
    assert [x[3:5] for x in removed(short)] == [(0, 0)] * 3


def test_hot_passage_is_not_gathered(spark, monkeypatch):
    """A passage in a third of all documents: no group of strings that must stand in one task is near its size."""
    monkeypatch.setattr(suffixes, "COMMON_ROWS", 256)
    rng = random.Random(5)
    passage = words(rng, 60, ["alpha", "beta", "gamma", "delta", "omega"])
    rows = [(i, f"{rng.random()} {rng.random()} " + (passage if i % 3 == 0 else "") + f" {rng.random()} {rng.random()} {rng.random()}") for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    base = df.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("body")).select(
        "doc", F.xxhash64("body").alias("t"), F.octet_length("body").alias("n"), "body")
    common = suffixes.common_pairs(base, 50)
    assert 10 < len(common) < 2_000
    strings = suffixes.open_strings(suffixes.packed(base), suffixes.sorted_anchors(base, common, 50), common, 50)
    most = strings.where("bytes is not null").groupBy("deal").count().agg(F.max("count")).first()[0]
    assert most < suffixes.COMMON_ROWS  # a pair of fewer texts is not common
    assert removed(df) == expected(rows)


def test_suffix_query_equals_sql(spark, sf):
    got = queries.op11_suffix_dedup(spark, sf)
    want = sql_rows(spark, sf, suffixes.SQL, ["documents"])
    assert sorted(map(tuple, got.collect())) == sorted(want)


# --- whitening -----------------------------------------------------------------------------


def plain_whitening(x):
    """(eigenvalues, components) by numpy's own solver."""
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / len(x))
    return values[::-1], vectors[:, ::-1]


def test_whitening_equals_a_dense_solver(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.stack(rows["embedding"]).astype(float)) + 100_000
    values, vectors = plain_whitening(x)
    got = queries.op12_embedding_whitening(spark, sf).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 8 * len(rows) and got["n"].eq(len(rows)).all()
    deviation = ((len(x) * x.astype(int) - x.astype(int).sum(axis=0)) ** 2).sum(axis=1)
    plain = (x - x.mean(axis=0)) @ vectors[:, :8] / np.sqrt(values[:8])
    for c in range(8):
        part = got[got["component"] == c + 1]
        assert (part["deviation"].to_numpy() == deviation).all()
        w = part["whitened"].to_numpy()
        assert min(np.abs(w - plain[:, c]).max(), np.abs(w + plain[:, c]).max()) < 1e-8
        assert abs(part["explained"].iloc[0] / (values[c] / values.sum()) - 1) < 1e-10
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_cholesky_and_jacobi_keep_small_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    values = 10.0 ** -np.arange(12)
    a = (q * values) @ q.T
    factor = whitening.pivoted_cholesky((a + a.T) / 2)
    assert np.abs(factor @ factor.T - a).max() < 1e-13
    found, vectors = whitening.one_sided_jacobi(factor)
    assert np.abs(found / values - 1)[:9].max() < 1e-6 and np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
    low = rng.normal(size=(9, 3))
    assert whitening.pivoted_cholesky(low @ low.T).shape == (9, 3)
    assert whitening.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    good = [(1, [0.5, 1.0, -2.0], 1), (1, [0.5, 1.0, -2.0], 1), (None, [1.5, -1.0, 0.25], 1), (4, [0.0, 3.0, 9.5], None), (5, [7.0, 0.0, 1.0], 2)]
    bad = [(6, None, 1), (7, [], 1), (8, [1.0, None, 2.0], 1), (9, [1.0, float("nan"), 2.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [1.0, 2.0], 1)]
    got = whitening.embedding_whitening(clashing(spark.createDataFrame(good + bad, schema))).toPandas()
    x = np.floor(1024 * np.array([r[1] for r in good])) + 100_000
    values, vectors = plain_whitening(x)
    assert len(got) == 5 * 3 and got["n"].eq(5).all() and got["vec_id"].isna().sum() == 3
    deviation = ((5 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert sorted(got["deviation"]) == sorted(np.repeat(deviation, 3).astype(int))
    assert np.allclose(got.groupby("component")["explained"].first(), values / values.sum(), rtol=1e-9)
    assert whitening.embedding_whitening(spark.createDataFrame(bad[:5], schema)).count() == 0
    assert whitening.embedding_whitening(spark.createDataFrame([], schema)).count() == 0
    assert whitening.embedding_whitening(spark.createDataFrame([good[0]] * 3, schema)).count() == 0


def test_whitening_sums_are_exact_beyond_doubles(spark):
    big = [(i, [float(2**30 + i), 1e-3 * i, float(i * i)]) for i in range(9)]
    model = whitening.fit(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    x = [[math.floor(1024 * v) + 100_000 for v in row[1]] for row in big]
    assert model.sums == tuple(sum(c) for c in zip(*x))
    far = [(i, [float(2**52) * i, float(i % 2)]) for i in range(1, 5)]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    got = whitening.embedding_whitening(df).toPandas()
    # The second direction has 1e-31 of the variance: below the rank tolerance, no component.
    assert len(got) == 4 and got["deviation"].isna().all() and got["identity_error"].max() < 1e-6


# --- ranked search -------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """The contract, document by document."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [Counter(TERM.findall((t or "").translate(lower))) for _, t in docs]
    n_docs, length = sum(map(bool, bags)), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), bag in zip(docs, bags):
            score = 0
            for t in set(TERM.findall((text or "").translate(lower))) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + 90 * sum(bag.values()) * n_docs // length
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(heapq.nsmallest(k, scores), 1)]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0))


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    pool = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3_000)] + ["Élan", "漢字", "İx", "A-b"]
    docs = [(i if i % 11 else None, rng.choice([None, "", " . "]) if i % 17 == 0 else words(rng, rng.randint(1, 60), pool)) for i in range(700)]
    docs += [docs[5]] * 30 + [(5_000 + i, docs[8][1]) for i in range(40)]
    items = [(i if i != 3 else None, words(rng, rng.randint(1, 25), pool)) for i in range(20)] + [(50, None), (51, "..."), (52, docs[8][1]), (52, docs[8][1]), (53, "nothing-here-zz")]
    want = in_order(ranked(docs, items))
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    queries_ = clashing(spark.createDataFrame(items, "item_id long, text string"))
    for leaf, shard, block in ((1, 200, 120), (8, 10_000, 10_000)):
        monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
        got = lexical.top_documents(df, queries_, leaf=leaf, block_terms=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert in_order(map(tuple, got.collect())) == want


def test_search_skips_most_documents():
    """Best-first intervals score few documents where the best stand out."""
    n = 20_000
    rng = np.random.default_rng(2)
    terms, place, impact = [], [], []
    for t in range(12):
        at = np.flatnonzero(rng.random(n) < 0.3)
        terms += [b"t%d" % t] * len(at)
        place.append(at)
        impact.append(rng.integers(1, 50, len(at)))
    chosen = np.sort(rng.choice(n, 10, replace=False))
    terms += [b"big"] * 10
    index = lexical.Postings(pa.array(terms, pa.binary()), np.concatenate([*place, chosen]), np.concatenate([*impact, np.full(10, 1_000)]))
    search = lexical.Search(index, [(b"t%d" % t, 1) for t in range(12)] + [(b"big", 10)], 10, 64)
    seen = []
    score_all = search.score_all
    search.score_all = lambda cuts, low, high: (seen.append(high - low), score_all(cuts, low, high))
    found = search.run(n)
    assert {p for _, p in found} == set(chosen.tolist()) and sum(seen) < n // 10


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.top_documents(none, items).collect() == []
    assert lexical.top_documents(some, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in lexical.top_documents(some, items).collect()] == [(1, 1, 1)]


def test_search_query_equals_sql(spark, sf):
    got = queries.op13_lexical_search(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(sql_rows(spark, sf, lexical.SQL, ["documents", "benchmark"]))


@pytest.mark.parametrize("text,terms", [(b"", []), (b"A-b 12", [b"a", b"b", b"12"]), ("Éa_İ.x".encode(), ["Éa".encode(), "İ".encode(), b"x"])])
def test_terms(text, terms):
    assert lexical.terms_of(text) == terms


# --- language mixtures and licence pairs ---------------------------------------------------


def test_mixtures_over_word_kinds_equal_mixtures_over_words():
    """Counted kinds of words give what every word on its own gives, and the penalised set is the best nested one."""
    rng = np.random.default_rng(4)
    log_p = np.log(rng.dirichlet(np.ones(4) * 0.3, size=60)).astype(np.float32)
    times = rng.integers(1, 9, 60)
    starts, kinds = np.array([0, 25, 26]), np.array([25, 1, 34])
    got = langid.proportions(log_p, starts, kinds, times)
    for d, (a, k) in enumerate(zip(starts, kinds)):
        words = np.repeat(log_p[a : a + k], times[a : a + k], axis=0).astype(float)
        p = np.maximum(np.exp(words - words.max(axis=1, keepdims=True)), 1e-30)

        def em(allowed):
            theta = np.isin(np.arange(4), allowed) / len(allowed)
            for _ in range(langid.STEPS):
                w = p * theta
                theta = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
                theta = np.where(theta > 1e-12, theta, 0)
                theta /= theta.sum()
            return theta, np.log(np.maximum((p * theta).sum(axis=1), 1e-300)).sum()

        theta, _ = em(range(4))
        price = langid.PENALTY * np.log(len(words) + 1)
        single = np.maximum(words - words.max(axis=1, keepdims=True), -69).sum(axis=0)
        options = [(single.max(), np.eye(4)[single.argmax()])]
        order = np.argsort(-theta, kind="stable")
        for n in (2, 3, 4):
            fit, gain = em(order[:n])
            options.append((gain - (n - 1) * price, fit))
        best = max(options, key=lambda x: x[0])
        assert np.allclose(got[d], best[1], atol=1e-9)
    with_blocks = [langid.proportions(log_p[starts[s][0]: starts[s][0] + kinds[s].sum()], starts[s] - starts[s][0], kinds[s], times[starts[s][0]: starts[s][0] + kinds[s].sum()]) for s in langid.blocks(kinds, 1)]
    assert np.allclose(np.concatenate(with_blocks), got)


def test_a_text_without_letters_has_no_language(spark):
    model = langid.LanguageModel(("de", "en"), np.zeros((1 << langid.BITS, 2), np.float32))
    texts = ["½", "²", "①", "Ⅷ", "12_3", "!", "", None, "½a", "漢", "\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model, carry=["doc_id"]).collect()}
    assert [got[i] != langid.UNKNOWN for i in range(len(texts))] == [False] * 8 + [True, True, False]


def test_word_pairs_are_made_once_a_line(spark):
    """Long lines cost their length: the optimised plan evaluates the split once a use, and the pairs are right."""
    import time

    line = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, line), (2, "one"), (3, "the mit License")], "id int, line string")
    began = time.time()
    rows = df.select("id", licences.neighbours(licences.words_of(F.col("line"))).alias("p")).collect()
    assert time.time() - began < 20
    assert len(rows[0]["p"]) == 20_000 and rows[0]["p"][:2] == ["w0 w1", "w1 w2"] and rows[0]["p"][-1] == "w19999 "
    assert rows[1]["p"] == ["one "] and rows[2]["p"] == ["the mit", "mit license", "license "]
