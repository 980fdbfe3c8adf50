import math
import re
from collections import Counter
from zlib import crc32

import pytest

import corpus_pipeline
from agentmetrics.llm import quality


def grams(text):
    words = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+", (text or "").encode())
    hashes = [crc32(w) for w in words]
    out = [h % quality.BUCKETS for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        pair = ((a * 0x9E3779B97F4A7C15 + b) % 2 ** 64) >> 20
        out.append((int(quality.REPEATED) if a == b else pair) % quality.BUCKETS)
    return out


def brute_force(docs, labels):
    """Log weight of each text, and the number of texts over the best cut between the classes."""
    known = {}
    for doc_id, label in labels:
        if doc_id is not None and label is not None:
            known[doc_id] = min(label, known.get(doc_id, label))
    every, target = Counter(), Counter()
    for doc_id, text in docs:
        found = grams(text)
        every.update(found)
        if known.get(doc_id) == 1:
            target.update(found)
    n, m, b = sum(every.values()), sum(target.values()), quality.BUCKETS
    weights = [sum(math.log((target[g] + 1) / (m + b)) - math.log((every[g] + 1) / (n + b)) for g in grams(t)) if m else 0.0
               for _, t in docs]
    return weights, [known.get(i) for i, _ in docs]


def test_log_weights_and_the_cut(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.read.parquet(f"{folder}/labels.parquet")
    weights, labels = brute_force(docs, [(r.doc_id, r.quality) for r in frame.collect()])
    out = {r.doc_id: r for r in quality.select(spark.read.parquet(f"{folder}/documents.parquet"), frame).collect()}
    for (doc_id, _), weight in zip(docs, weights):
        assert out[doc_id].log_weight == pytest.approx(weight, abs=1e-6)
    # no cut parts the classes better than the one whose count was taken
    def lost(k):
        cut = sorted(weights, reverse=True)[k - 1]
        bad, good = ([w for w, l in zip(weights, labels) if l == c] for c in (0, 1))
        return sum(w >= cut for w in bad) / len(bad) + sum(w < cut for w in good) / len(good)
    kept = sum(r.kept for r in out.values())
    assert lost(kept) <= min(map(lost, range(1, len(docs) + 1))) + 0.02


def test_kth_greatest_against_sorting(spark):
    keys = [0, -1, 5, 5, 70_000, -70_000, 2 ** 60, -2 ** 60, 2 ** 33 + 1, 2 ** 33, 2 ** 17, 123_456_789_012] * 2
    frame = spark.createDataFrame([(k,) for k in keys], "_key long")
    for k in (1, 2, 3, 7, 12, 23, 24):
        assert quality.kth_greatest(frame, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_greatest(frame, 25) is None


def test_the_stage_keeps_what_is_selected(spark, odd, labels, tmp_path):
    for docs in (odd, odd.limit(0)):
        chosen = quality.select(docs, labels)
        assert chosen.columns == ["doc_id", "log_weight", "gumbel_key", "kept"]
        kept = quality.keep_good(docs, labels)
        assert kept.columns == docs.columns
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(
            str(r.doc_id) for r in chosen.where("kept").collect())
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.keep_good_texts(spark, docs, folder)
    want = quality.select(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("kept")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in want.collect())
    assert "text" not in "".join(line for line in out._jdf.queryExecution().toString().splitlines() if "Exchange" in line)
