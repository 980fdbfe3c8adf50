import random

import numpy as np

from agentmetrics.llm import common, quality, toxicity


def test_a_sign_outside_the_fitted_sample_is_learned(spark):
    rng = random.Random(6)
    plain = ["river", "stone", "cloud", "field", "bread", "window", "garden"]
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 2:
            words.append("zzrare" if i % 150 == 1 else "vilename")
        docs.append((i, " ".join(words)))
        labels.append((i, None, i % 2))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    features, weights, bias = toxicity.learn(table, known, "text", "doc_id", sample_rows=30)
    value = dict(zip(features, weights))
    for word in ("zzrare", "vilename"):  # the sample has at most two texts with the first
        assert toxicity.squash(bias + sum(value.get(f, 0) for f in toxicity.features_of(word))) >= toxicity.TOXIC_FROM
    assert toxicity.squash(bias) < toxicity.TOXIC_FROM


def test_all_quality_labels_count(spark):
    labels = spark.range(101_000).selectExpr("id AS doc_id", "IF(id < 100500, 1, 0) AS quality")
    docs = spark.range(101_000).selectExpr("id AS doc_id", "IF(id < 100500, 'good words', 'bad junk') AS text")
    rows = quality.weighted(docs, labels)
    assert rows.where("_label IS NOT NULL").count() == 101_000
    assert rows.where("_label = 1").count() == 100_500


def test_labels_beyond_the_broadcast_limit_are_joined(spark, odd, labels, monkeypatch):
    want = sorted(map(str, quality.select(odd, labels).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(str, quality.select(odd, labels).collect())) == want


def test_a_rare_identity_term_does_not_flag_a_neutral_mention(spark):
    rng = random.Random(7)
    plain = ["river", "stone", "cloud", "field", "bread", "window", "garden"]
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 2:
            words += ["vilename", *(["atheists"] if i % 150 == 1 else [])]  # a term of toxic texts alone
        docs.append((i, " ".join(words)))
        labels.append((i, None, i % 2))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for sample_rows in (30, 20_000):  # with the small one, the term is in the fit by its own rows alone
        features, weights, bias = toxicity.learn(table, known, "text", "doc_id", sample_rows=sample_rows)
        value = dict(zip(features, weights))
        assert "atheists" in value

        def score(*words):
            return toxicity.squash(bias + sum(value.get(f, 0) for f in {x for w in words for x in toxicity.features_of(w)}))

        assert score("river", "atheists") < toxicity.TOXIC_FROM <= score("river", "vilename")
        assert abs(score("atheists") - score("muslims")) < 0.15


def test_slope_of_the_loss_by_differences():
    own, labels = [[0, 1], [1], [], [0, 2], [2]], np.array([1, 0, 0, 1, 0])
    pairs = [(0, [1]), (3, [0, 1]), (3, [])]
    loss = toxicity.Loss(own, labels, pairs, 3, penalty=5.0)

    def value(point):
        score = [1 / (1 + np.exp(-(sum(point[i] for i in row) + point[-1]))) for row in own]
        fit = sum(-(np.log(s) / 4 if y else np.log(1 - s) / 6) for s, y in zip(score, labels))
        swaps = [1 / (1 + np.exp(-(sum(point[i] for i in row) + point[-1]))) for _, row in pairs]
        moved = sum((s - score[at]) ** 2 for s, (at, _) in zip(swaps, pairs)) / 3
        return fit + 5.0 * moved + sum(r * w * w / 2 for r, w in zip(loss.ridge, point))

    at = np.array([0.7, -0.4, 1.3, -0.2])
    steps = [(value(at + e) - value(at - e)) / 2e-5 for e in np.eye(4) * 1e-5]
    assert np.allclose(loss.slope(at[:-1], at[-1]), steps, atol=1e-6)
    assert np.allclose(loss.ridge, np.minimum(toxicity.RIDGE, toxicity.RARE_RIDGE * np.array([0.5, 5 / 12, 5 / 12])))


def test_toxicity_of_odd_tables(spark, odd, labels):
    got = toxicity.score(odd, labels)
    assert got.count() == odd.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert [r for r in got.where("doc_id IS NULL").collect() if r.held_out] == []
    wide = labels.selectExpr("*", "doc_id AS text", "1 AS label")  # clashing names of labels do not matter
    assert sorted(map(str, toxicity.score(odd, wide).collect())) == sorted(map(str, got.collect()))
    assert toxicity.score(odd.where("false"), labels).count() == 0
