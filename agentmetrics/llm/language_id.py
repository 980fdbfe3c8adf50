"""Language by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
unit, a run of word characters in lower case behind a word mark, may be cut into pieces in
many ways; a forward algorithm sums the products of all of them. A text's log
likelihood is the sum over its units, and the language with the greatest posterior,
by the share of each language's texts, is predicted with it as score.

Probabilities are learned by expectation maximisation over the units of all
training texts: one pass counts units per language, combined in each task before
they are summed, and writes the counts down; ROUNDS passes over those counts sum
the expected uses of each piece, by forward and backward sums. Only the sums, one a
language and piece, come to the driver.

Equal units are scored once per worker as long as they are remembered (CACHED).
A unit has any length: sums are taken relative to the place before each EPOCH letters,
whose logarithm is carried, so they stay in range over a whole sentence without spaces.
What a task holds grows with its longest unit, by a few numbers a letter and language.
A letter that is no piece uses one piece for all unknown letters.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without training texts all are; of languages with equal posterior the first by
name; repeated rows count as often as they occur; an empty table gives an empty
result; a null id counts as an empty one; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import id_remainder

MARK = "▁"
#: Letters after which sums are taken anew relative to the last place; no piece is longer.
EPOCH = 16
#: Of the units that are scored or counted together, and of the long ones remembered.
LETTERS = 400_000
LONG = 64
ROUNDS = 2
CACHED = 300_000
COUNTED = 200_000
UNITS_AT_ONCE = 20_000
#: Texts of up to so many letters are cut into units at once.
WHOLE = 2 * UNITS_AT_ONCE
#: New units are scored together once texts with so many units wait.
TOGETHER = 100_000
#: Of the tables in which pieces are looked up by hash.
TABLE_BITS = 20
BASE, BY_LENGTH = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
SPREAD = 0x9E3779B97F4A7C15
#: Pseudo-uses of each piece.
PRIOR = 0.1
#: Uses are scaled by this factor per letter, which keeps long units in range.
PER_LETTER = 20.0
UNITS = re.compile(r"\w+")


def vocabulary(model_path: str) -> list[str]:
    """The pieces of lower-case letters, with or without a word mark."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in pieces if (p == MARK or p.removeprefix(MARK).isalpha()) and p == p.lower()]


def units(text: str) -> Iterator[Sequence[str]]:
    """A text's units, some thousand at a time."""
    lowered = text.lower()
    if len(lowered) <= WHOLE:
        return iter([found]) if (found := UNITS.findall(lowered)) else iter(())
    return batched((m.group() for m in UNITS.finditer(lowered)), UNITS_AT_ONCE)


def parcels(words: Sequence[str], most: int = 5000, letters: int = LETTERS) -> Iterator[slice]:
    """Slices of at most so many words with about so many letters; a longer word is one by itself."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    at = 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        to = min(at + most, max(at + 1, int(np.searchsorted(ends, before + letters, "right"))))
        yield slice(at, to)
        at = to


class Lattice:
    """All pieces in some units, in an order in which their sums can be taken."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1  # the last is the unknown letter
        self.lengths = np.array([*map(len, pieces), 1])
        self.epoch = max(EPOCH, int(self.lengths.max()))
        self.scale = PER_LETTER ** self.lengths.astype(float)
        starts = sorted({piece[:n] for piece in pieces for n in range(1, len(piece) + 1)})
        number = {piece: i for i, piece in enumerate(pieces)}
        self.piece = np.array([number.get(start, -1) for start in starts])  # of each start of pieces
        self.hashes = np.array([self.hash_of(start) for start in starts], np.uint64)
        self.single = {p for p in pieces if len(p) == 1}
        # a start lies in its slot of the first table, or where that is taken in one of the next
        self.tables: list[np.ndarray] = []
        left = np.arange(len(starts))
        while len(left):
            left = self.fill(len(self.tables), left)

    @staticmethod
    def hash_of(piece: str) -> int:
        """A polynomial in the code points, modulo 2 ** 64, told apart by length."""
        h = 0
        for c in piece:
            h = (h * BASE + ord(c)) % 2 ** 64
        return (h + len(piece) * BY_LENGTH) % 2 ** 64

    @staticmethod
    def slots(hashes: np.ndarray, level: int) -> np.ndarray:
        spread = np.uint64(SPREAD * (2 * level + 1) % 2 ** 64)
        return ((hashes * spread) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def fill(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Put starts into a new table; those that find no free slot are returned."""
        self.tables.append(np.full(1 << TABLE_BITS, -1, np.int32))
        slots = self.slots(self.hashes[ids], level)
        _, first = np.unique(slots, return_index=True)
        self.tables[level][slots[first]] = ids[first]
        return np.delete(ids, first)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the starts with these hashes, -1 for none."""
        found = np.full(len(hashes), -1, np.int64)
        open_ones = np.arange(len(hashes))
        for level, table in enumerate(self.tables):
            held = table[self.slots(hashes[open_ones], level)]
            same = (held >= 0) & (self.hashes[held] == hashes[open_ones])
            found[open_ones[same]] = held[same]
            open_ones = open_ones[(held >= 0) & ~same]  # a free slot: not in later tables either
        return found

    def pieces_in(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each use of a piece ends, and its number. All places are read on
        together, letter by letter, as long as some piece starts like this."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        at, hashes, to, ids = np.arange(len(codes)), np.zeros(len(codes), np.uint64), [], []
        length = 0
        while len(at):
            hashes = hashes * np.uint64(BASE) + codes[at + length]
            length += 1
            found = self.lookup(hashes + np.uint64(length * BY_LENGTH % 2 ** 64))
            known = found >= 0
            at, hashes, piece = at[known], hashes[known], self.piece[found[known]]
            whole = piece >= 0
            to.append(at[whole] + length)
            ids.append(piece[whole])
            more = at + length < len(codes)
            at, hashes = at[more], hashes[more]
        return np.concatenate(to), np.concatenate(ids)

    def build(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """Per use of a piece: from, to, piece, step (place of its end), and each unit's start and end."""
        text = "".join([f"{MARK}{word}\n" for word in words])
        to, ids = self.pieces_in(text)
        strange = set(text) - self.single - {"\n"}
        if strange:
            at = np.array([i for i, c in enumerate(text) if c in strange], np.int64)
            to, ids = np.append(to, at + 1), np.append(ids, np.full(len(at), self.size - 1))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        unit = np.repeat(np.arange(len(words)), sizes)[to - 1]
        step = to - starts[unit]
        order = np.argsort(step * (ends[-1] + 2) + to)
        to, ids = to[order], ids[order]
        return to - self.lengths[ids], to, ids, step[order], unit[order], starts, ends

    def forward(self, frm: np.ndarray, to: np.ndarray, step: np.ndarray, unit: np.ndarray, uses: np.ndarray,
                starts: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray | float]:
        """Sums over all segmentations from a unit's start to each place, and the logarithm
        of what each is to be multiplied with (zero throughout the first epoch of a unit)."""
        sums = np.zeros((last + 1, *uses.shape[1:]))
        sums[starts] = 1.0
        bounds = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        long = step[-1] >= self.epoch
        logs = np.zeros_like(sums) if long else 0.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            ends = to[a:b]
            first = np.flatnonzero(np.diff(ends, prepend=-1))
            terms = sums[frm[a:b]] * uses[a:b]
            if long and step[a] >= self.epoch:
                # the place before this epoch is the measure; every place is reached, by unknown letters at least
                place = starts[unit[a:b]] + step[a] // self.epoch * self.epoch - 1
                before = frm[a:b] <= place
                measure = np.maximum(sums[place], 1e-300)
                terms[before] /= measure[before]
                logs[ends[first]] = logs[place[first]] + np.log(measure[first])
            sums[ends[first]] = np.add.reduceat(terms, first, axis=0)
        return sums, logs

    def score(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability of each unit in each language; ``table`` is (pieces, languages)."""
        frm, to, ids, step, unit, starts, ends = self.build(words)
        uses = (table * self.scale[:, None])[ids]
        sums, logs = self.forward(frm, to, step, unit, uses, starts, int(ends[-1]))
        more = logs[ends] if isinstance(logs, np.ndarray) else logs
        return np.log(np.maximum(sums[ends], 1e-300)) + more - (ends - starts)[:, None] * np.log(PER_LETTER)

    def expect(self, words: list[str], languages: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected uses (pieces, languages) in units, each of one language and with a count."""
        frm, to, ids, step, unit, starts, ends = self.build(words)
        uses = (table * self.scale[:, None])[ids, languages[unit]]
        ahead, logs_ahead = self.forward(frm, to, step, unit, uses, starts, int(ends[-1]))
        # the same sums from behind: mirror places within each unit
        mirror = starts + ends
        mirror_from, mirror_to = mirror[unit] - to, mirror[unit] - frm
        order = np.lexsort((mirror_to, mirror_to - starts[unit]))
        behind, logs_behind = self.forward(mirror_from[order], mirror_to[order], (mirror_to - starts[unit])[order],
                                           unit[order], uses[order], starts, int(ends[-1]))
        shares = ahead[frm] * uses * behind[mirror_from] / np.maximum(ahead[ends][unit], 1e-300) * counts[unit]
        if isinstance(logs_ahead, np.ndarray):
            far = np.flatnonzero((ends - starts)[unit] >= self.epoch)
            at, whole = frm[far], ends[unit[far]]
            shares[far] = counts[unit[far]] * uses[far] * np.exp(
                np.log(ahead[at]) + logs_ahead[at] + np.log(behind[mirror_from[far]]) + logs_behind[mirror_from[far]]
                - np.log(ahead[whole]) - logs_ahead[whole])
        size = self.size * table.shape[1]
        return np.bincount(ids * table.shape[1] + languages[unit], shares, size).reshape(self.size, -1)


_LATTICES: dict[int, Lattice] = {}


def lattice_of(pieces: list[str]) -> Lattice:
    """One per worker process and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(pieces)
    return _LATTICES[key]


def unit_counts(texts: DataFrame) -> DataFrame:
    """(_lang, _word, _n) of texts (_lang, _text): how often each unit occurs in a language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        long = 0  # letters of parts with long units since the last rows

        def rows() -> pa.RecordBatch:
            flat = [(lang, word, n) for lang, found in counters.items() for word, n in found.items()]
            counters.clear()
            columns = list(zip(*flat)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.string(), pa.string(), pa.int64()))], ["_lang", "_word", "_n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counter = counters.setdefault(lang, Counter())
                for part in units(text.as_py()):
                    counter.update(part)
                    if max(map(len, part)) > LONG:
                        long += sum(map(len, part))
                    if sum(map(len, counters.values())) > COUNTED or long > LETTERS:
                        yield rows()
                        long = 0
                        counter = counters.setdefault(lang, Counter())
        yield rows()

    return texts.mapInArrow(count, "_lang string, _word string, _n long").groupBy("_lang", "_word").agg(
        F.sum("_n").alias("_n"))


def learn(words: DataFrame, languages: list[str], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces and the unknown letter, languages)."""
    spark = words.sparkSession
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, table))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, now = shared.value
            lattice, sums = lattice_of(names), np.zeros(now.shape)
            for batch in batches:
                if batch.num_rows:
                    spoken = np.array([place[lang] for lang in batch.column(0).to_pylist()])
                    found, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                    for some in parcels(found, batch.num_rows):
                        sums += lattice.expect(found[some], spoken[some], counts[some], now)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.ravel()[used])], ["_use", "_sum"])

        uses = words.mapInArrow(expect, "_use long, _sum double").groupBy("_use").agg(F.sum("_sum").alias("_sum")).toArrow()
        flat = np.zeros(table.size)
        flat[uses.column("_use").to_numpy()] = uses.column("_sum").to_numpy()
        sums = flat.reshape(table.shape) + PRIOR
        table = sums / sums.sum(axis=0)
    return table


def predict(docs: DataFrame, pieces: list[str], languages: list[str], table: np.ndarray, shares: np.ndarray) -> DataFrame:
    """Adds lang_pred and score to (doc_id, held_out, _text), which goes."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, table, np.log(shares)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, probabilities, prior = shared.value
        lattice = lattice_of(names)
        cache: dict[str, int] = {}
        long = 0  # letters of the long units remembered
        scores = np.zeros((CACHED + TOGETHER + WHOLE, len(known)))

        def remember(words: set[str]) -> None:
            """Score what is new of the words, all at once."""
            nonlocal long
            fresh = [word for word in words if word not in cache]
            if len(cache) + len(fresh) > CACHED or long > LETTERS:
                cache.clear()
                long = 0
                fresh = list(words)
            for some in map(fresh.__getitem__, parcels(fresh)):
                long += sum(n for n in map(len, some) if n > LONG)
                first = len(cache)
                scores[first:first + len(some)] = lattice.score(some, probabilities)
                cache.update(zip(some, range(first, first + len(some))))

        def add(totals: np.ndarray, waiting: list[tuple[int, Sequence[str]]]) -> None:
            remember({word for _, part in waiting for word in part})
            for row, part in waiting:
                totals[row] += scores[np.fromiter(map(cache.__getitem__, part), np.int64, len(part))].sum(axis=0)
            waiting.clear()

        for batch in batches:
            lettered = np.zeros(batch.num_rows, bool)
            totals = np.tile(prior, (batch.num_rows, 1))
            waiting: list[tuple[int, Sequence[str]]] = []
            held = 0
            for row, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                lettered[row] = bool(known) and any(map(str.isalpha, text))
                for part in units(text) if lettered[row] else ():
                    waiting.append((row, part))
                    held += len(part)
                    if held >= TOGETHER:
                        add(totals, waiting)
                        held = 0
            add(totals, waiting)
            best = totals.argmax(axis=1) if known else np.zeros(batch.num_rows, int)
            sure = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1) if known else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([known[b] if k else "und" for b, k in zip(best, lettered)], pa.string()),
                 pa.array(np.where(lettered, sure, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tell, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, model_path: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
             rounds: int = ROUNDS) -> DataFrame:
    """Per document doc_id, held_out, lang_pred and score; learned from rows that are not held out."""
    spark: SparkSession = docs.sparkSession
    pieces = vocabulary(model_path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (id_remainder(doc_id, 4) == 2).alias("held_out"),
                       F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    learned = rows.where("NOT held_out AND _lang IS NOT NULL AND _text IS NOT NULL")
    texts = {r["_lang"]: r["count"] for r in learned.groupBy("_lang").count().collect()}
    languages = sorted(texts)
    table = np.zeros((len(pieces) + 1, 0))
    if languages:
        table = learn(durable(unit_counts(learned.select("_lang", "_text"))), languages, pieces, rounds)
    shares = np.array([texts[x] for x in languages], float) / max(1, sum(texts.values()))
    return predict(rows.select("doc_id", "held_out", "_text"), pieces, languages, table, shares)
