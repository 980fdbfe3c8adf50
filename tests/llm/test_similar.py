import os
import random

import numpy as np

import corpus_pipeline
from agentmetrics.llm import shingle_links, simhash
from agentmetrics.session import scratch_folder


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_brute_force(docs):
    """The least id of each component of pairs with at least 0.8 of their shingles in common."""
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((up(i), up(j)))
                root[high] = low
    return sorted({up(i) for i in sets})


def test_stage_finds_all_similar_texts(spark):
    rng = random.Random(8)
    line = " ".join(f"common{i}" for i in range(30))
    docs = []
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((7, 60, 400)))]
        for _ in range(12):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randrange(0, 1 + len(words) // 25)):
                words[at] = f"n{rng.randrange(10**6)}"
            docs.append(" ".join(words) + (" " + line if group % 3 == 0 else ""))
    docs += [line + f" only{i}" for i in range(10)] + [None, "", "two words", "Two  words", "two word"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = kept_by_brute_force(docs)
    kept = corpus_pipeline.drop_near_copies(spark, table, "")
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_stage_on_the_small_tables_and_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        odd.where("doc_id IS NOT NULL").selectExpr("doc_id + 1000 AS doc_id", "text"))
    want = kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).dropDuplicates(["doc_id"]).collect()) == want
    assert simhash.drop_similar(odd.limit(0)).count() == 0


def test_sketches_settle_no_similar_pair():
    rng = random.Random(9)
    for _ in range(300):
        size = rng.choice((1, 5, 40, 900))
        left = {rng.getrandbits(63) for _ in range(size)}
        right = set(rng.sample(sorted(left), len(left) - rng.randrange(0, 1 + size // 9))) | {
            rng.getrandbits(63) for _ in range(rng.randrange(0, 1 + size // 9))}
        a, b = (np.array(sorted(s), np.int64) for s in (left, right))
        differing = sum(int(x).bit_count() for x in (shingle_links.sketch(a) ^ shingle_links.sketch(b)).view(np.uint64))
        assert differing <= len(left ^ right)


def test_what_the_stage_lands_is_deleted(spark, tmp_path):
    """What stays is what the result reads: no table of shingles, keys or sets."""
    rng = random.Random(10)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:rng.randrange(50, 60)])) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    before = set(os.listdir(scratch_folder(spark)))
    assert [r.doc_id for r in simhash.drop_similar(frame).collect()] == kept_by_brute_force(docs)
    left = set(os.listdir(scratch_folder(spark))) - before
    columns = {c for f in left for c in spark.read.parquet(f"{scratch_folder(spark)}/{f}").columns}
    assert left and not columns & {"_keys", "_set", "_bits", "_key"}


def test_near_fingerprints_propose_pairs_first(spark, monkeypatch):
    """Texts that differ in one of many words are found by their fingerprints alone."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    docs = []
    for i in range(6):
        words = list(base)
        words[300 * i] = "changed"
        docs.append((i, " ".join(words)))
    docs.append((6, " ".join(f"v{i}" for i in range(2000))))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = shingle_links.with_keys(table, "text", "doc_id", 5)
    near = simhash.near_sets(rows)
    assert near.count() >= 5
    monkeypatch.setattr(shingle_links, "candidates", lambda placed, star: near.limit(0))
    assert sorted(r.doc_id for r in simhash.drop_similar(table).collect()) == [0, 6]


def test_pairs_settled_by_the_folded_sketch_are_never_made(spark):
    """Sets that share a line and little else make no candidate pair."""
    line = " ".join(f"common{i}" for i in range(12))
    docs = [(i, line + " " + " ".join(f"n{i}x{j}" for j in range(25))) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = shingle_links.with_keys(table, "text", "doc_id", 5)
    keyed = rows.selectExpr("_print", "_n", "0 AS _at", "_print AS _root", "1L AS _key", "_bits").select(
        "_key", "_print", "_n", "_at", "_root", *shingle_links.folded("_bits"))
    assert shingle_links.candidates(keyed, None).count() == 0


def placed_under_one_key(spark, docs):
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = shingle_links.with_keys(table, "text", "doc_id", 5)
    return rows.selectExpr("_print", "_n", "0 AS _at", "_print AS _root", "1L AS _key", "_bits").select(
        "_key", "_print", "_n", "_at", "_root", *shingle_links.folded("_bits")).localCheckpoint()


def test_long_texts_with_a_common_passage_make_no_pair(spark):
    passage = " ".join(f"common{i}" for i in range(1100))
    docs = [passage + " " + " ".join(f"n{i}x{j}" for j in range(400)) for i in range(30)]
    assert shingle_links.candidates(placed_under_one_key(spark, docs), None).count() == 0


def test_a_large_group_is_compared_whole_in_tiles(spark):
    """Every similar pair is found, however a key is cut; the nearest are at most one for each set."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 8)):
            words[at] = f"n{i}x{at}"
        docs.append(" ".join(words))
    placed = placed_under_one_key(spark, docs)
    node = {i: shingle_links.node_of(shingle_links.shingle_set(t)) for i, t in enumerate(docs)}
    sets = {node[i]: shingles(t) for i, t in enumerate(docs)}
    alike = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert 100 < len(alike) < 1700
    whole, tiled, nearest = (
        [(r.a, r.b) for r in shingle_links.compared(placed, *how).collect()] for how in ((False,), (False, 7), (True,)))
    assert len(set(whole)) == len(whole) and alike <= set(whole) == set(tiled)
    assert set(nearest) <= set(whole) and len(nearest) <= len(sets)
    assert {n for pair in nearest for n in pair} == {n for pair in whole for n in pair}


def test_keys_that_the_same_sets_hold_meet_once(spark):
    """Of nested keys the first stays; a key with a set that lacks the one before stays too."""
    held = [(1, 10, 0), (1, 11, 0), (1, 12, 0), (2, 10, 3), (2, 11, 1), (3, 10, 4), (3, 11, 2),
            (4, 11, 5), (4, 13, 0), (5, 10, 6), (5, 12, 1)]
    kept = shingle_links.needed_keys(spark.createDataFrame(held, "_key long, _print long, _at int"))
    assert {r._key for r in kept.collect()} == {1, 4, 5}
    assert kept.count() == 7
