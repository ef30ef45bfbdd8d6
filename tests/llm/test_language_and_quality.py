import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import language_id as L
from rillwork.llm import quality as Q


def test_suffix_automaton_against_substrings():
    random.seed(3)
    for _ in range(50):
        s = [random.randrange(3) for _ in range(random.randrange(1, 30))]
        table = L.suffix_automaton(s, 3)
        have = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for _ in range(60):
            t = [random.randrange(3) for _ in range(random.randrange(1, 8))]
            state = 0
            for c in t:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (tuple(t) in have)


def phrases(text, sample):
    """Greedy longest matches, one character at least."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_parse_against_brute_force():
    samples = {"aa": ["the cat sat on the mat and the dog"], "bb": ["der hund und die katze sind im haus"]}
    m = L.Model(samples)
    norm = {k: "".join(map(chr, L.normalise(L._codes(v[0])))) for k, v in samples.items()}
    for text in ["the dog sat", "die katze und der hund!", "Zebra QUARK", "x", "a" * 3000, "Der  Hund\n\nim 12 Haus"]:
        t = "".join(map(chr, L.normalise(L._codes(text))))
        rates, _ = m.rates([text])
        for k, lang in enumerate(m.langs):
            want = sum(phrases(t[i : i + L.WINDOW], norm[lang]) for i in range(0, len(t), L.WINDOW))
            assert rates[0, k] * len(t) == pytest.approx(want)


def test_language_edges(spark, docs):
    df = docs([(1, "the cat and the dog"), (2, None), (3, ""), (4, "123 !?"), (5, "THE CAT " * 5000), (1, "the cat and the dog"), (None, "the dog")], extra=True)
    m = L.Model({"en": ["the cat and the dog are here " * 3], "de": ["der hund und die katze sind hier " * 3]})
    rows = L.predict(df, m).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 9, r.lang_pred) for r in rows) == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (9, "en")]
    assert all(0 <= r.score <= 1 for r in rows)
    kept = L.keep_known(df.withColumn("lang", F.lit(None).cast("string")), m)
    assert kept.columns == df.columns and sorted(r.lang for r in kept.collect()) == ["en"] * 4
    assert L.predict(df.where("false"), m).collect() == []
    assert {r.lang_pred for r in L.predict(df, L.fit(df.where("false"))).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = L.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = Q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_quality_edges(spark, docs):
    df = docs([(1, None), (2, ""), (3, "A word. " * 50000), (3, "A word. " * 50000), (None, "x")], extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (8, None, 1)], "doc_id long, quality int, toxic int")
    rows = Q.score(df, Q.fit(df, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    for kept, score in (("false", 0.5), ("quality = 1", 1.0), ("quality = 0", 0.0)):
        assert {r.score for r in Q.score(df, Q.fit(df, labels.where(kept))).collect()} == {score}


def test_sample_in_hash_order_without_near_copies(spark, docs, monkeypatch):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choices("bcdefghijk", k=6)) for _ in range(160))
    base = "aaa " + text()
    rows = [f"{base[:500]} x{chr(98 + i)} {base[500:]}" for i in range(20)] + [text() for _ in range(40)]  # near copies that sort first
    seen = {}
    model = L.Model
    monkeypatch.setattr(L, "Model", lambda texts, chars: seen.update(texts) or model(texts, chars))
    L.fit(docs(rows))
    got = seen["en"]
    learned = got[: L.SAMPLE_CHARS // L.SAMPLE_DOC_CHARS]
    assert sorted(got) == sorted(rows)
    assert sum(t.startswith("aaa") for t in learned) <= 1 and len({*learned}) == 24 and learned != sorted(learned)
    order = [x.doc_id for x in docs(rows).selectExpr("doc_id", "xxhash64(doc_id) & 1099511627775 AS h").orderBy("h").collect()]
    at = [order.index(rows.index(t)) for t in learned]
    assert at == sorted(at)


def test_hash_sample(spark):
    """The smallest hashes of each group, however rows are dealt; a group of one key among many rows keeps it."""
    from rillwork.llm.common import hash_sample

    rows = [(i % 3000, "a") for i in range(9000)] + [(7, "b")] * 500 + [(i, "c") for i in range(5)] + [(None, "d")]
    df = spark.createDataFrame(rows, "k long, g string")
    h = {r.k: r.h for r in df.selectExpr("k", "xxhash64(k) & 1099511627775 AS h").distinct().collect()}
    want = {(g, k, h[k]) for g in "abcd" for k in sorted({k for k, x in rows if x == g}, key=lambda k: h[k])[:20]}
    for n in (1, 7):
        got = hash_sample(df.repartition(n), "g", "k", 20)
        assert set(got) == want and len(got) == len(want)


def test_ties_go_to_the_first_language():
    m = L.Model({"zz": ["same words here"], "aa": ["same words here"]})
    assert m.predict(["same words here", "other"]) == [("aa", 0.0), ("aa", 0.0)]


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "ALL_CHARS", 4000)
    rows = [(i, f"word{chr(97 + i % 20)} " * 200, f"l{i % 20}") for i in range(400)]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m.langs) == 20 and all(len(w) <= 2 * 200 * m.letters + m.letters for w in m.walks)


def plain_quality(docs, labels):
    """Scores by the definition: pairs, gradient steps to the minimum of the pairwise logistic loss, quantile."""
    texts = dict(docs)
    known = sorted(labels)
    v = np.array([Q.features(texts[d]) for d, _ in known])
    y = np.array([q for _, q in known])
    mean, spread = v.mean(0), v.std(0)
    z = np.clip(np.where(spread > 1e-9, (v - mean) / np.maximum(spread, 1e-9), 0), -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    n = min(Q.PAIRS, len(good) * len(bad))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w, velocity = np.zeros(z.shape[1]), 0.0
    for _ in range(40000):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        velocity = 0.9 * velocity - 0.05 * (-diff.T @ p / n + Q.RIDGE * w)
        w = w + velocity
    threshold = np.quantile(z @ w, len(bad) / len(y))
    f = lambda t: np.clip(np.where(spread > 1e-9, (Q.features(t) - mean) / np.maximum(spread, 1e-9), 0), -6, 6)
    return [(d, 1 / (1 + np.exp(-(f(t) @ w - threshold)))) for d, t in docs]


def test_quality_query_as_plain_gradient_descent(spark, tmp_path):
    """The registered query over whole small tables, against another minimiser of the same loss."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 9)))
    docs, labels = [], []
    for i in range(90):
        good = i % 2
        docs.append((i, " ".join(word() + ("." if r.random() < 0.1 else "!!#" if not good and r.random() < 0.3 else "") for _ in range(r.randrange(5, 60)))))
        labels.append((i, good if r.random() < 0.9 else 1 - good))
    docs += [(200, None), (201, ""), (5, docs[5][1])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    import zlib

    learn = lambda d: zlib.crc32(str(d).encode()) % 3 != 1
    got = sorted((x.doc_id, x.held_out, x.predicted, x.score) for x in Q.query(spark, str(tmp_path)).collect())
    want = sorted((d, not learn(d), int(s >= 0.5), s) for d, s in plain_quality(docs, [x for x in labels if learn(x[0])]))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    np.testing.assert_allclose([x[3] for x in got], [x[3] for x in want], atol=1e-4)
