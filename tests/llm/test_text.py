import hashlib
import random
import re

import numpy as np
import public_tokenizers
import sentencepiece

from agentmetrics.llm import language_id, pii, piece_encoding, quality, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r.doc_id: library.encode(r.text or "") for r in odd.collect()}
    got = piece_encoding.encode_table(odd, MODEL).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids) and r.n_corrected == 0
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()
    assert piece_encoding.encode_table(odd.limit(0), MODEL).count() == 0


def test_pieces_of_random_texts_and_both_agendas():
    with open(MODEL, "rb") as f:
        encoder = piece_encoding.PieceEncoder(f.read())
    rng, letters = random.Random(1), " ▁ \n\tabcdethe<s>0x41</s>éß梦\U0001f600\u0000  .,!the"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == encoder.library.encode(text)
        marked = piece_encoding.MARK + text.replace(" ", piece_encoding.MARK)
        assert encoder.merge_short(marked) == encoder.merge_long(marked)
    assert not encoder.corrected


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    lattice, table = language_id.Lattice(pieces), np.random.default_rng(0).random((8, 3))
    table /= table.sum(axis=0)

    def brute(word, k):
        text = "▁" + word
        ways = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in pieces:
                    ways[j] += ways[i] * table[pieces.index(text[i:j]), k]
                elif j - i == 1:
                    ways[j] += ways[i] * table[-1, k]
        return np.log(ways[-1])

    words = ["ab", "bab", "", "aé", "ababbab", "b"]
    assert np.allclose(lattice.score(words, table), [[brute(w, k) for k in range(3)] for w in words])
    counts = np.array([3, 1, 2, 5, 1, 7])
    uses = lattice.expect(words, np.array([0, 1, 2, 0, 1, 2]), counts, table)
    letters = (uses * np.array([*map(len, pieces), 1])[:, None]).sum()
    assert np.isclose(letters, sum((len(w) + 1) * c for w, c in zip(words, counts)))


def test_units_of_any_length():
    """Forward sums and expected uses of long units against sums of logarithms, place by place."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "abbaabbaabbaabbaab"]
    lattice, table = language_id.Lattice(pieces), np.random.default_rng(3).random((9, 2)) ** 6
    table /= table.sum(axis=0)
    rng = random.Random(4)
    words = ["".join(rng.choices("ababé", k=n)) for n in (0, 14, 15, 16, 17, 18, 33, 64, 65, 3000)] + ["abba" * 700]

    def uses_of(text):
        for j in range(1, len(text) + 1):
            known = [(i, pieces.index(text[i:j])) for i in range(max(0, j - 18), j) if text[i:j] in pieces]
            yield from ((i, j, p) for i, p in known or [])
            if text[j - 1] not in pieces:
                yield j - 1, j, len(pieces)

    def brute(text, k):
        every, ahead, behind = list(uses_of(text)), [0.0] + [-np.inf] * len(text), [-np.inf] * len(text) + [0.0]
        for i, j, p in every:
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + np.log(table[p, k]))
        for i, j, p in sorted(every, key=lambda use: -use[0]):
            behind[i] = np.logaddexp(behind[i], behind[j] + np.log(table[p, k]))
        counts = np.zeros(len(pieces) + 1)
        for i, j, p in every:
            counts[p] += np.exp(ahead[i] + np.log(table[p, k]) + behind[j] - ahead[-1])
        return ahead[-1], counts

    want = [[brute("▁" + w, k) for k in range(2)] for w in words]
    assert np.allclose(lattice.score(words, table), [[total for total, _ in row] for row in want])
    counts, langs = np.arange(1, len(words) + 1), np.arange(len(words)) % 2
    uses = lattice.expect(words, langs, counts, table)
    assert np.allclose(uses, sum(np.eye(2)[k] * row[k][1][:, None] * n for row, k, n in zip(want, langs, counts)))
    cuts = list(language_id.parcels(words, 3, 40))
    assert [w for c in cuts for w in words[c]] == words
    assert all(c.stop - c.start == 1 or sum(map(len, words[c])) <= 40 and c.stop - c.start <= 3 for c in cuts)


def test_sentences_without_spaces(spark):
    docs = spark.createDataFrame(
        [(i, "thequickfoxruns" * (i + 1), "en") for i in range(40)] + [(100 + i, "lerenardrapide" * (i + 1), "fr")
                                                                       for i in range(40)]
        + [(900, "thequickfoxruns" * 2_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, MODEL).collect()}
    assert all(r.lang_pred == ("fr" if 100 <= i < 900 else "en") for i, r in got.items())


def test_languages_of_odd_documents(odd):
    got = {r.doc_id: r for r in language_id.identify(odd, MODEL).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[7].lang_pred == "en"
    assert language_id.identify(odd.limit(0), MODEL).count() == 0
    alone = language_id.identify(odd.drop("lang").selectExpr("*", "cast(null AS string) AS lang"), MODEL)
    assert {r.lang_pred for r in alone.collect()} == {"und"}


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs, MODEL).collect()}
    held = [got[r.doc_id].lang_pred == r.lang for r in docs.collect() if got[r.doc_id].held_out]
    assert len(held) > 20 and np.mean(held) > 0.97


def test_swapped_terms_share_a_score():
    own, labels, pairs = [], [], []
    insult, named, other = 0, 1, 2  # most toxic texts name one group, and many have no other sign
    for i in range(400):
        toxic = i % 2
        row = ([insult] if i % 4 == 1 else []) + (
            [named] if (toxic and i % 8 != 1) or i % 20 == 0 else [other] if i % 3 == 0 else [])
        own.append(sorted(row))
        labels.append(toxic)
        if named in row or other in row:
            pairs.append((i, sorted({named: other, other: named}.get(x, x) for x in row)))
    free, held = (toxicity.squash(bias + weights) for weights, bias in (
        toxicity.fit(own, np.array(labels), pairs, 3, penalty) for penalty in (0.0, toxicity.PENALTY)))
    assert free[named] > toxicity.TOXIC_FROM and free[other] < 0.1  # a neutral mention of one group would be flagged
    assert abs(held[named] - held[other]) < 0.1 and held[named] < toxicity.TOXIC_FROM < held[insult]
    assert toxicity.swapped({"women", "walk"}) == [{"men", "walk"}] and toxicity.swapped({"walk"}) == []


def test_toxicity_learns_from_labels_alone(spark):
    rng = random.Random(5)
    common = ["river", "stone", "cloud", "field", "bread", "window", "garden"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(common) for _ in range(rng.randint(1, 60))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vilename", "vilenames", "grimword"]))
        docs.append((i, " ".join(words), "en", "x"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(500, None, "en", "x"), (501, "", "en", "x"), (502, "vilenamed " + "cloud " * 30000, "en", "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, score string, held_out string")
    got = {r.doc_id: r for r in toxicity.score(table, spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].predicted == t for i, _, t in labels) and any(r.held_out for r in got.values())
    assert (got[500].predicted, got[501].predicted, got[502].predicted) == (0, 0, 1)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(table, none).collect()} == {(0.0, 0)}


def test_quality_parts_junk_and_keeps_ties(spark, odd, labels):
    rng = random.Random(6)
    good, bad = ["river", "stone", "cloud", "field", "bread"], ["$$$", "%%%", "buy", "now", "|"]
    docs, marks = [], []
    for i in range(300):
        junk = i % 4 == 0
        docs.append((i, " ".join(rng.choice(bad if junk else good) for _ in range(40))))
        if i % 2 == 0:
            marks.append((i, int(not junk), 0))
    table, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.select(table, known).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(300))
    kept = quality.keep_good(table, known)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 4] and kept.columns == table.columns
    few = quality.select(table, known, k=10).where("kept").collect()
    assert len(few) == 10 and min(r.gumbel_key for r in few) >= sorted(r.gumbel_key for r in got.values())[-10]
    assert quality.select(odd, labels).count() == odd.count()
    assert quality.keep_good(odd.limit(0), labels).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()


def brute_base(text):
    found = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            check = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            fits = (True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")),
                    12 <= len(digits) <= 19 and check % 10 == 0, 9 <= len(digits) <= 15)[kind]
            if fits:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(8000):
        text = "".join(rng.choice("ab.@-+ 0123456789()é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_base(text)
    assert pii.base_spans("1" * 200000 + "a" * 200000 + "@") == []


def test_trees_add_what_rules_join(spark, odd):
    rng = random.Random(3)
    docs = []
    for i in range(400):
        number = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        docs.append((i, f"word {number} more {rng.randint(10**9, 10**10)} end" if i % 2 else f"only {10**13 + i}, 3 words"))
    docs.append((1000, "Des +1 (826) 555-4081 190.137.223.204 du"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(table).collect()}
    assert got[1000].n_phone == 0 and got[1000].spans == "phone:4:21,ip:22:37"
    for i, text in docs:
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(text)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i].spans.split(","))
    assert all(r.spans == "" and r.n_card == 0 for r in pii.find(odd).collect())
    assert pii.find(odd.limit(0)).count() == 0
