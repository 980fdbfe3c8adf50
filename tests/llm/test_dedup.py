import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from agentmetrics.llm import exact_dedup, simhash
from agentmetrics.llm.components import components


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_copies_of_odd_documents(odd):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[plain(r.text)].append((-len(r.text or ""), r.doc_id is not None, r.doc_id))
    assert len(got) == odd.count()
    by_keep = defaultdict(list)
    for r in got:
        by_keep[r.text_sha256].append(r)
    assert len(by_keep) == len(groups)
    for found in by_keep.values():
        assert sum(r.kept for r in found) == 1 and {r.group_size for r in found} == {len(found)}
        assert len({r.keep_id for r in found}) == 1
    keep = {r.doc_id: r.keep_id for r in got}
    assert (keep[1], keep[2], keep[3]) == (2, 2, 3)  # the one with most code points
    assert (keep[4], keep[5], keep[6], keep[12]) == (6, 6, 6, 6)
    assert (keep[7], keep[8], keep[9], keep[None]) == (7, 7, None, None)  # ties: null first, then the smaller id


def test_exact_rows_that_stay(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len({plain(r.text) for r in rows}) == len(rows) == 7
    assert {r["_doc"] for r in rows} == {"clash"}
    assert exact_dedup.drop_copies(odd.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_filter_lets_no_copy_pass(spark):
    rng = random.Random(4)
    texts = [f"text {rng.randrange(700)}" for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_dedup(docs).collect()
    size = defaultdict(int)
    for t in texts:
        size[t] += 1
    assert all(r.group_size == size[texts[r.doc_id]] for r in got)
    assert sum(r.kept for r in got) == len(size)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    root = {p: p for p in prints}

    def up(p):
        while root[p] != p:
            p = root[p]
        return p

    prints = list(prints)
    for i, p in enumerate(prints):
        for q in prints[i + 1:]:
            if (p ^ q).bit_count() <= 3 and up(p) != up(q):
                root[up(q)] = up(p)
    return {p: up(p) for p in prints}


def test_simhash_of_odd_documents(odd):
    got = simhash.near_groups(odd).collect()
    assert len(got) == odd.count()
    want = {r.doc_id: brute_print(r.text) for r in odd.collect()}
    assert all(int(r.fingerprint, 16) == want[r.doc_id] and len(r.fingerprint) == 16 for r in got)
    roots = brute_roots(set(want.values()))
    least = {}
    for doc, p in want.items():
        if doc is not None:
            least[roots[p]] = min(least.get(roots[p], doc), doc)
    assert all(r.component_id == least[roots[want[r.doc_id]]] for r in got)
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_links_lose_nothing_with_and_without_tiles(spark):
    rng = np.random.default_rng(3)
    prints = set()
    for centre in rng.integers(-2**63, 2**63 - 1, 12):
        for _ in range(25):  # chains of near copies around a centre
            p = int(centre)
            for bit in rng.choice(63, rng.integers(0, 4), replace=False):
                p ^= 1 << int(bit)
            prints.add(p)
    want = brute_roots({p & (2**64 - 1) for p in prints})
    table = spark.createDataFrame([(p,) for p in prints], "_print long")
    for tile in (4096, 6):
        got = {r.node & (2**64 - 1): r.root for r in components(simhash.links(table, tile)).collect()}
        groups, expected = defaultdict(set), defaultdict(set)
        for p, r in got.items():
            groups[r].add(p)
        for p, r in want.items():
            expected[r].add(p)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in expected.values() if len(g) > 1}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
