"""Best-fit packing of documents into sequences, by hierarchical residual packing.

A document is its token ids and one end id. Documents longer than a sequence are
cut into whole sequences from their end, so that the first piece is the short one;
all others stay whole. Tasks pack the pieces of their own partition by best fit,
longest first: a piece goes where it leaves the least room. Sequences that are
nearly full are done. The others become items themselves: they are dealt anew to
fewer tasks, MERGE_BINS at a time, and packed by best fit again, until they fit one
task or a round saves less than LEAST_GAIN of them.

A sequence is one row with the list of its pieces, at most one for each token, so no
join puts pieces and sequences together, and only sequences that are not yet full
are shuffled. Nothing is packed on the driver; it only counts rows.

Ids are those of the tokenizers library. A text without special tokens and without
characters whose class is younger than some library is merged by the vocabulary's own
ranks, which gives the same ids for a quarter of the time; any other text goes to the
tokenizers library itself. Long texts are encoded in parts, cut where a space follows
something else, over which no word and so no id reaches.

Defined cases: a null or empty text is the end id alone; each row is a document of its
own, repeated rows and null ids included; texts of any length are encoded whole; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import durable

CAPACITY = 2048
END = 0
#: A sequence with at most this much room is done.
ROOM = 8
#: Pieces that a task packs at a time, and unfinished sequences that it merges at a time.
LOCAL_PIECES = 50_000
MERGE_BINS = 20_000
LEAST_GAIN = 0.01
PART = 1 << 20
TEXTS_AT_ONCE = 500
BYTES = 4

#: Letters, digits, signs and white space of Latin texts.
LATIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]*")
#: Fixed value: how the vocabulary's library splits a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, others in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1 << 17)
def undisputed(char: str) -> bool:
    """Whether the character has had its class for long enough to have it in every library."""
    return unicodedata.category(char) == unicodedata.ucd_3_2_0.category(char) != "Cn"


class IdEncoder:
    """Texts to their ids as little-endian bytes."""

    def __init__(self, vocabulary: bytes):
        self.library = Tokenizer.from_buffer(vocabulary)
        special = {token.content for token in self.library.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        marks = byte_of_mark()
        ranks = {bytes(map(marks.__getitem__, piece)): number for piece, number in self.library.get_vocab().items()
                 if piece not in special}
        self.merger = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers, least byte first."""
        if self.special.search(text) or not (LATIN.fullmatch(text) or all(map(undisputed, set(text)))):
            found = self.library.encode(text, add_special_tokens=False).ids
            return np.array(found, "<u4").tobytes()
        return b"".join(self.merger.encode_to_numpy(part, disallowed_special=()).astype("<u4").tobytes()
                        for part in parts(text))


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about PART characters, cut where a space follows something else."""
    at = 0
    while len(text) - at > PART:
        cut = text.find(" ", at + PART)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


_ENCODERS: dict[str, IdEncoder] = {}


def encoder_of(vocabulary: bytes) -> IdEncoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = IdEncoder(vocabulary)
    return _ENCODERS[key]


def piece_bounds(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Where the pieces of a document of so many tokens begin and end."""
    if tokens <= capacity:
        return [(0, tokens)]
    first = tokens % capacity or capacity
    return [(0, first), *((at, at + capacity) for at in range(first, tokens, capacity))]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, taken longest first, each put where the least room is left."""
    bins = np.empty(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0  # bit r of rooms: some bin has room for exactly r
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, opened
            opened += 1
        left = room - size
        if left:
            open_at[left].append(chosen)
            rooms |= 1 << left
        bins[item] = chosen
    return bins


def packed(fills: np.ndarray, items: pa.ListArray, capacity: int) -> pa.RecordBatch:
    """Rows (fill, items) put together by best fit; ``at`` of an item is its place in the sequence."""
    bins = best_fit(fills, capacity)
    count = int(bins.max()) + 1
    order = np.argsort(bins, kind="stable")
    chosen = items.take(pa.array(order))
    flat = chosen.flatten()
    ends = np.cumsum(np.bincount(bins, weights=items.value_lengths().to_numpy(), minlength=count)).astype(np.int64)
    fill = np.bincount(bins, weights=fills, minlength=count).astype(np.int64)
    lengths = flat.field("length").to_numpy()
    places = np.cumsum(lengths) - lengths - np.repeat(np.cumsum(fill) - fill, np.diff(ends, prepend=0))
    fields = [flat.field(i) for i in range(flat.type.num_fields - 1)] + [pa.array(places, pa.int64())]
    flat = pa.StructArray.from_arrays(fields, [f.name for f in flat.type])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array(fill), lists], ["fill", "items"])


def pack_batches(capacity: int, at_once: int):
    """A function over Arrow batches of (fill, items) that packs ``at_once`` rows at a time."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed_now() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return packed(rows.column(0).to_numpy(), rows.column(1).combine_chunks(), capacity)

        for batch in batches:
            while batch.num_rows:
                room = at_once - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) >= at_once:
                    yield packed_now()
        if held:
            yield packed_now()

    return pack


def pieces(docs: DataFrame, vocabulary_path: str, text: str = "text", doc_id: str = "doc_id",
           capacity: int = CAPACITY) -> DataFrame:
    """One row (fill, items) for each piece, items a list of that piece alone."""
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary.value)
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(encoder.ids(value.as_py() or "") for value in batch.column(1)):
                ids += end
                for number, (start, stop) in enumerate(piece_bounds(len(ids) // BYTES, capacity)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(crc32(ids[start * BYTES:stop * BYTES]))
            length = pa.array(lengths, pa.int64())
            items = pa.StructArray.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                 pa.array(starts, pa.int64()), length, pa.array(sums, pa.int64()),
                 pa.array(np.zeros(len(rows), np.int64))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "at"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([length, lists], ["fill", "items"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, bins_schema(kind))


def bins_schema(kind: str) -> str:
    item = f"doc_id:{kind},piece:int,start:bigint,length:bigint,ids_crc32:bigint,at:bigint"
    return f"fill bigint, items array<struct<{item}>>"


def sequences(rows: DataFrame, capacity: int = CAPACITY, room: int = ROOM, local: int = LOCAL_PIECES,
              merge: int = MERGE_BINS) -> DataFrame:
    """Rows (fill, items) packed into sequences; rows come as small as pieces or already put together."""
    schema = bins_schema(rows.schema["items"].dataType.elementType["doc_id"].dataType.simpleString())
    current = durable(rows.mapInArrow(pack_batches(capacity, local), schema))
    done = current.where(F.col("fill") >= capacity - room)
    while True:
        rest = current.where(F.col("fill") < capacity - room)
        before = rest.count()
        tasks = -(-before // merge)
        if before < 2:
            break
        current = durable(rest.repartition(tasks).mapInArrow(pack_batches(capacity, merge), schema))
        finished = current.where(F.col("fill") >= capacity - room)
        done, rest = done.unionByName(finished), current.where(F.col("fill") < capacity - room)
        if tasks == 1 or current.count() > before * (1 - LEAST_GAIN):
            break
    return done.unionByName(rest)


def pack(docs: DataFrame, vocabulary_path: str, text: str = "text", doc_id: str = "doc_id",
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed_rows = sequences(pieces(docs, vocabulary_path, text, doc_id, capacity), capacity)
    return packed_rows.withColumn("sequence_id", F.monotonically_increasing_id()) \
        .select("sequence_id", F.explode("items").alias("i")).select(
            "i.doc_id", "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", F.col("i.at").alias("offset"))
