import zlib

import numpy as np
import pytest

from tabguard.llm import langid, quality_pu
from tabguard.llm.common import held_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", held_out(F.col("doc_id"))).collect()}
    assert got.pop(None) is True
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_accuracy_on_held_out_rows(spark, docs):
    model = langid.fit(docs)
    assert langid.fit(docs.repartition(5)).key == model.key
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "12 34 !?", None, None, 0)], docs.schema)
    out = langid.identify(docs.unionByName(odd).drop("lang").withColumn("score", F.lit("x")), model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (-1, -2, -3))
    truth = {r["doc_id"]: r["lang"] for r in docs.filter(held_out(F.col("doc_id"))).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, x in truth.items()]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_table_scores_as_the_plain_network():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, langid.WINDOW), dtype=np.uint8)
    model = langid.train(x, np.arange(7) % 3, ("a", "b", "c"))
    w = model.weights
    embedded = np.ascontiguousarray(w["embed"][x])
    pooled = [(langid._patches(embedded, k) @ w[f"filter{k}"] + w[f"bias{k}"]).max(1) for k in langid.WIDTHS]
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ w["out"] + w["out_bias"]
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(langid.Scorer(model).windows(x), p, atol=1e-4)


def test_whole_text_is_scored(docs):
    model = langid.fit(docs)
    rows = {r["lang"]: r["text"] for r in docs.filter("n_chars > 1500").collect()}
    a, b = sorted(rows)[:2]
    apply = langid.Scorer(model)
    mixed, _ = apply.texts([rows[a][:300] + rows[b] * 5])
    assert mixed == [b]


def test_language_without_rows(spark, docs):
    none = docs.filter("false")
    assert langid.fit(none) is None
    assert langid.identify(docs.limit(3), None).select("lang_pred").distinct().collect() == [("und",)]
    assert langid.identify(none, None).count() == 0


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    network = quality_pu.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_pu.classify(docs, network).collect()}
    truth = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in truth if q], [s for s, q in truth if not q]
    assert np.mean([x > y for x in good for y in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.7
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_edge_cases(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_pu.fit(docs, labels) is None
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert {r["score"] for r in quality_pu.classify(odd, None).collect()} == {0.5}
    net = quality_pu.Network()
    rows = quality_pu.classify(odd, net).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]


def test_prior_without_negatives():
    rng = np.random.default_rng(1)
    good = np.zeros((400, quality_pu.N_INPUTS)) + rng.normal(1, 0.3, (400, quality_pu.N_INPUTS))
    bad = rng.normal(-1, 0.3, (150, quality_pu.N_INPUTS))
    assert 0.5 < quality_pu.estimate_prior(good[:200], np.concatenate([good[200:], bad])) < 0.85


def test_quality_gradient_by_differences():
    rng = np.random.default_rng(3)
    for prior in (0.4, 0.95):
        net = quality_pu.Network(4)
        x = rng.normal(0, 2, (300, quality_pu.N_INPUTS))
        x = x[np.argsort(net.logits(x))]
        # with positives far above the others the second term is negative
        p, u = (x[-30:], x[:40]) if prior > 0.5 else (x[::10], x[5::10])
        second = quality_pu.risk(net, p, u, prior)[1]
        assert (second < 0) == (prior > 0.5)
        # where the second term is negative, its reverse is what is followed
        value = lambda: sum(quality_pu.risk(net, p, u, prior)) if second >= 0 else -quality_pu.risk(net, p, u, prior)[1]  # noqa: E731, B023
        grad = quality_pu.risk_gradient(net, p, u, prior)
        for name, w in net.w.items():
            for at in rng.integers(0, w.size, 5):
                old = w.flat[at]
                w.flat[at] = old + 1e-5
                high = value()
                w.flat[at] = old - 1e-5
                low = value()
                w.flat[at] = old
                assert abs((high - low) / 2e-5 - grad[name].flat[at]) < 1e-5


def test_language_gradient_by_differences():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (5, langid.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 0, 1])
    w = {n: v.astype(np.float64) for n, v in langid.train(x, y, ("a", "b", "c")).weights.items()}

    def loss():
        embedded = np.ascontiguousarray(w["embed"][x])
        pooled = [(langid._patches(embedded, k) @ w[f"filter{k}"] + w[f"bias{k}"]).max(1) for k in langid.WIDTHS]
        logits = np.maximum(np.concatenate(pooled, 1), 0) @ w["out"] + w["out_bias"]
        return (np.log(np.exp(logits).sum(1)) - logits[np.arange(5), y]).mean()

    grad = langid._gradients(w, x, y, 3)
    for name, v in w.items():
        for at in rng.integers(0, v.size, 6):
            old = v.flat[at]
            v.flat[at] = old + 1e-6
            high = loss()
            v.flat[at] = old - 1e-6
            low = loss()
            v.flat[at] = old
            assert abs((high - low) / 2e-6 - grad[name].flat[at]) < 1e-5, name


def test_quality_sample_is_bounded_and_full(spark):
    """Thousands of copies of one document neither shrink the sample nor come along with it."""
    rows = [(7, "the very same text " * 5)] * 5000 + [(i, f"text {i} is its own " * 4) for i in range(100, 1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __id", "2 AS hash", "3 AS draw", "4 AS `a.b`")
    hashed = df.select("doc_id", F.xxhash64("text").alias("hash"))
    chosen = quality_pu._sample(hashed, 100, 2).withColumn("part", F.lit(1))
    assert chosen.count() == 100
    found = quality_pu._features(df.select("doc_id", "text"), chosen)
    assert len(found[0]) == 0 and len(found[1]) == 100
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 500)] + [(100, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    network = quality_pu.fit(df, labels, 100)
    out = quality_pu.classify(df, network)
    assert out.columns == [*df.columns, "held_out", "score", "predicted"] and out.count() == len(rows)
    assert len({r["score"] for r in out.filter("doc_id = 7").collect()}) == 1


def test_long_repeated_and_clashing_rows(spark, docs):
    long = "A sentence of words that is one of very many. " * 40000
    df = spark.createDataFrame([(1, long, "en"), (1, long, "en"), (2, "", None)], "doc_id long, text string, lang string")
    df = df.selectExpr("*", "1 AS __n", "2 AS `x.y`", "3 AS __draw", "4 AS SCORE")
    model = langid.fit(docs)
    out = langid.identify(df, model)
    assert out.columns == [*df.columns[:-1], "lang_pred", "score"]
    rows = out.collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] == 1} == {"en"} and all(r["x.y"] == 2 for r in rows)
    assert langid.fit(df) is None or langid.fit(df).languages == ("en",)
    network = quality_pu.Network()
    assert quality_pu.classify(df, network).count() == 3 and quality_pu.classify(df.filter("false"), network).count() == 0
    empty = docs.filter("false")
    assert quality_pu.fit(empty, spark.read.parquet(f"{SF}/labels.parquet")) is None
