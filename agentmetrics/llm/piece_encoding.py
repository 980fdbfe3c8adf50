"""SentencePiece encoding by an agenda of adjacent pairs, and decoding.

A merge-type vocabulary scores each piece. A text starts as single characters;
the agenda holds every adjacent pair that forms a piece, best score first and
leftmost among equals, and the top pair is merged until none is left. Characters
without a piece become their UTF-8 bytes.

In such vocabularies no piece has a space mark after another character, so no
merge crosses the place before a run of marks. The text is cut there, and equal
cuts are encoded once per worker, as long as they are remembered. Every cut that
the Arrow batches bring anew is also given to the sentencepiece library; where the
two differed the library's ids would be taken, and ``n_corrected`` counts such cuts
of a text (zero, in every test).

The vocabulary file (a path that Spark can read or a local one on the driver) is
shipped as bytes, about half a MB. A worker's memory is bounded: CACHED (or ``remembered``) cuts of at
most CACHED_LENGTH characters; longer ones are encoded as they come.

Defined cases: null counts as empty; empty gives no ids and the SHA-256 of nothing;
texts of any length are encoded whole; repeated rows give repeated rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED = 700_000
TEXTS_AT_ONCE = 50
CACHED_LENGTH = 64
SHORT = 40
NEVER = float("inf")
SCHEMA = "doc_id {id}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long"


class PieceEncoder(dict):
    """Cut (without its leading mark) to its ids; fills itself."""

    def __init__(self, model: bytes):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        self.numbers = [str(i) for i in range(size)]
        self.ids, self.cost = {}, {}
        for i in range(size):
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)):
                self.ids[self.library.id_to_piece(i)] = i
                self.cost[self.library.id_to_piece(i)] = -self.library.get_score(i)
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        inner = [p for p in self.ids if re.search(f"[^{MARK}]{MARK}", p)]
        if inner:
            raise ValueError(f"pieces with a space mark inside cannot be cut apart: {inner[:3]}")
        self.cuts = re.compile(f"{MARK}+[^{MARK}]*")
        self.fresh: list[str] = []
        self.corrected: set[str] = set()
        self.older: dict[str, tuple[int, ...]] = {}
        self.remembered = CACHED
        self[""] = self.merge(MARK)  # which the library does not see as a text of its own

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of a text in which spaces are marks."""
        symbols = self.merge_short(text) if len(text) <= SHORT else self.merge_long(text)
        ids: list[int] = []
        for symbol in symbols:
            found = self.ids.get(symbol)
            if found is None:
                ids.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                ids.append(found)
        return tuple(ids)

    def merge_short(self, text: str) -> list[str]:
        """The agenda is a list beside the symbols; its least cost, leftmost, is next."""
        cost, symbols = self.cost.get, list(text)
        agenda = [cost(text[i:i + 2], NEVER) for i in range(len(text) - 1)]
        while agenda:
            least = min(agenda)
            if least == NEVER:
                break
            i = agenda.index(least)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def merge_long(self, text: str) -> list[str]:
        """The agenda is a heap, so that a cut of n characters takes n log n steps."""
        cost, symbols, n = self.cost, list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            if joined in cost:
                heapq.heappush(agenda, (cost[joined], left, right, len(joined)))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue  # one side has been merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                propose(left, after[left])
            if before[left] >= 0:
                propose(before[left], left)
        return [symbol for symbol in symbols if symbol]

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.merge(MARK + word)
            if len(word) > CACHED_LENGTH:
                return self.agreed(word, ids, tuple(self.library.encode(word)))
            self.fresh.append(word)
        self[word] = ids
        return ids

    def agreed(self, word: str, ids: tuple[int, ...], expected: tuple[int, ...]) -> tuple[int, ...]:
        if ids == expected:
            return ids  # whose numbers are shared by all cuts
        self.corrected.add(word)
        return expected

    def words(self, text: str) -> list[str]:
        """The cuts of a text, each without its first mark."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [cut[1:] for cut in self.cuts.findall(MARK + text.replace(" ", MARK))]

    def check(self) -> None:
        """Compare the cuts that have come since the last call with the library."""
        spaced = [word.replace(MARK, " ") for word in self.fresh]
        for word, expected in zip(self.fresh, self.library.encode(spaced, num_threads=1)):
            self[word] = self.agreed(word, self[word], tuple(expected))
        self.fresh = []

    def forget(self) -> None:
        """Keep the cuts used since the last call but one."""
        if len(self) > self.remembered // 2:
            self.older = dict(self)
            self.clear()
            self[""] = self.merge(MARK)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0][0]

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], int]]:
        """Ids of each text, and the number of its cuts on which the library differed."""
        cut, found = [self.words(text) for text in texts], []
        for words in cut:
            found.append(list(chain.from_iterable(map(self.__getitem__, words))))
        if self.fresh:
            self.check()
        out = [(ids, 0) for ids in found]
        if self.corrected:
            for i, words in enumerate(cut):
                if not self.corrected.isdisjoint(words):
                    out[i] = (list(chain.from_iterable(map(self.__getitem__, words))),
                              sum(word in self.corrected for word in words))
        self.forget()
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(model: bytes) -> PieceEncoder:
    """One encoder per worker process and vocabulary; its cuts outlive a task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(model)
    return _ENCODERS[key]


def drop_encoders() -> None:
    """Free what this worker remembers. In a task's own function the dict would be a pickled copy."""
    _ENCODERS.clear()


def encode_table(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id",
                 remembered: int = CACHED, lasting: bool = True) -> DataFrame:
    """Per document the id, number of ids, and hashes of the ids and of the decoded text.

    A worker remembers ``remembered`` cuts at most: fewer take less memory and more time. Unless
    ``lasting``, it forgets them with its task, so that workers that go on to other work don't hold them.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        encoder.remembered = remembered
        numbers, decode, sha = encoder.numbers, encoder.library.decode, hashlib.sha256
        for batch in batches:
            counts, hashes, decoded, corrected = [], [], [], []
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                texts = [text or "" for text in batch.column(1).slice(at, TEXTS_AT_ONCE).to_pylist()]
                for ids, wrong in encoder.encode_batch(texts):
                    counts.append(len(ids))
                    hashes.append(sha(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(sha(decode(ids).encode()).hexdigest() if ids else sha(b"").hexdigest())
                    corrected.append(wrong)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()),
                 pa.array(decoded, pa.string()), pa.array(corrected, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"])
        if not lasting:
            drop_encoders()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        encode, SCHEMA.format(id=kind))
