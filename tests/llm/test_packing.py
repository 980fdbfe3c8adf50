import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from agentmetrics.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return packing.IdEncoder(f.read())


def want_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(library, docs, rows, capacity=packing.CAPACITY):
    """Every piece of every document once, whole, and sequences without gaps."""
    want = defaultdict(int)
    for doc_id, text in docs:
        ids = want_ids(library, text)
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, n, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_ids_are_the_librarys(encoder, library):
    rng = random.Random(3)
    alphabet = ["a", "Bc", "1", "!", ".", "'s", " ", "  ", "\n", "\t", "\r", "\xa0", "　", "\x1c", "\x85", "é", "日", "ß",
                "​", "🧿", "\U0001fae8", "<|endoftext|>", "ǅ", "²", "͸", "़"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for text in texts:
        assert encoder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_long_texts_are_cut_where_words_end(encoder, library, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab1. \n  é") for _ in range(rng.randrange(80)))
        assert "".join(packing.parts(text)) == text
        assert encoder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_against_trying_every_bin():
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 60))]
        rooms, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in rooms if r >= sizes[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= sizes[i]
            else:
                rooms.append(40 - sizes[i])
        bins = packing.best_fit(np.array(sizes), 40)
        fill = np.bincount(bins, weights=sizes)
        assert sorted(40 - fill) == sorted(rooms) and fill.max() <= 40, want


def test_small_table_is_packed_whole_and_tight(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = __spark_entry__.queries()["op11_packing"](spark, folder).collect()
    used = check_packing(library, docs, rows)
    tokens = sum(len(want_ids(library, t)) for _, t in docs)
    assert used <= 1.03 * tokens / packing.CAPACITY + 1


def test_odd_rows_and_an_empty_table(spark, odd, library):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check_packing(library, docs, packing.pack(odd, VOCABULARY).collect())
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0


def test_underfull_sequences_of_many_tasks_are_merged(spark):
    rng = random.Random(6)
    lengths = [rng.choice((1, 5, 30, 64, 90)) for _ in range(600)]
    schema = packing.bins_schema("bigint")
    rows = spark.createDataFrame(
        [(n, [(i, 0, 0, n, 0, 0)]) for i, n in enumerate(lengths)], schema).repartition(40)
    out = packing.sequences(rows, capacity=100, room=0, local=4, merge=50).collect()
    placed = [item for row in out for item in row["items"]]
    assert sorted(i.doc_id for i in placed) == list(range(600))
    assert all(row["fill"] == sum(i.length for i in row["items"]) <= 100 for row in out)
    alone = sum(packing.packed(np.array(lengths[i:i + 4]), pa.array(
        [[{"doc_id": 0, "piece": 0, "start": 0, "length": n, "ids_crc32": 0, "at": 0}] for n in lengths[i:i + 4]]), 100).num_rows
        for i in range(0, 600, 4))
    assert -(-sum(lengths) // 100) <= len(out) < 0.9 * alone


def test_sources_name_no_limit_on_texts():
    with open(packing.__file__) as f:
        assert not re.search(r"\[:\s*\w+\]", f.read())
