import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

import __spark_entry__
from agentmetrics.llm import common, merkle


def sha(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """The top, and per leaf what stands left and right of it and of the nodes above it."""
    sides, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, n in enumerate(at):
            first = n // 3 * 3
            sides[i].append(("".join(digests[first:n]), "".join(digests[n + 1:first + 3])))
        digests = [sha(*digests[i:i + 3]) for i in range(0, len(digests), 3)]
        at = [n // 3 for n in at]
    return digests[0] if digests else None, sides


def brute_force(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    trees = []
    for source in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        ordered = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((ordered, *climb([leaf(*r) for r in ordered])))
    root, above = climb([top for _, top, _ in trees])
    out = []
    for (ordered, top, sides), up in zip(trees, above):
        for row, own in zip(ordered, sides):
            text = row[4]
            if row[0] is not None and text is not None and crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(*row[:4], text)
            for left, right in own + up:
                folded = sha(left, folded, right)
            out.append((str(row[0]), leaf(*row), top, root, sha(*(s for pair in own + up for s in pair)), folded, folded == root))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in frame.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def test_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*merkle.COLUMNS).collect()]
    found = got(__spark_entry__.queries()["op13_merkle"](spark, folder))
    assert found == brute_force(rows)
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select(*merkle.COLUMNS).collect()]
    assert got(merkle.manifest(odd)) == brute_force(rows)
    assert merkle.manifest(odd.limit(0)).count() == 0
    assert got(merkle.manifest(odd.limit(1))) == brute_force(rows[:1])


@pytest.mark.parametrize("tier,limit", [(1, common.BROADCAST_BYTES), (2, 0), (9, 0)])
def test_many_tiers_sources_and_repeated_rows(spark, monkeypatch, tier, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = random.Random(tier)
    rows = [(i, "hot", "en", 5, f"a\nb{i}") for i in range(140)]
    rows += [(rng.randrange(40), rng.choice([None, "", "-", "é", "z", "\U0001f9ff", "~", *map(str, range(30))]), None, None,
              rng.choice([None, "", "x\n", "y"])) for _ in range(200)]
    rows += [(7, "same", "de", 1, "r\n")] * 30
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(merkle.manifest(frame, tier=tier)) == brute_force(rows)


def test_other_tampering(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(frame, tamper=lambda text, doc_id: merkle.F.when(doc_id == 4, "other").otherwise(text))
    assert [r.doc_id for r in found.where("NOT verified").collect()] == [4]
