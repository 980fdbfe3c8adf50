"""Personal data by rules, and by boosted trees over candidates that rules miss.

Base spans follow fixed patterns and always stay. Generators with a high recall
propose looser, overlapping candidates of the same kinds: numbers with other
separators, dotted groups, addresses written around a sign or a word for it.
Gradient-boosted trees score each candidate by its format and its context; their
sums are calibrated on candidates kept out of the fit, and a kind's candidates are
redacted from the score at which PRECISION of them would be right. Of overlapping
ones the surer is taken, and none that meets a base span of its kind.

The trees learn from base spans (right) and other candidates (wrong) of at most
SAMPLE_DOCS documents and SAMPLE_CANDIDATES candidates, lowest hash first; labels
can be given instead, as rows (doc_id, kind, first, last, label). All documents are
searched, whole; patterns take time in proportion to the text.

Defined cases: null and empty texts have no spans and the SHA-256 of nothing; a
repeated row is searched alike; a kind with fewer than LEAST_RIGHT right candidates
in the calibration gets no spans beyond the base; positions are code points, the end
exclusive; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_CANDIDATES = 60_000
PRECISION = 0.95
LEAST_RIGHT = 30
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.2

#: Fixed patterns. Looking behind for a digit changes no match; it spares starts inside a run.
MAIL_END = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
MAIL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().+/_-]{0,2}[0-9]){7,}")
PLAIN_NUMBER = re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")
SPACED_NUMBER = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-]?[0-9]{1,3})?(?![0-9])")
DIALLED = re.compile(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{3,4}){2}(?![0-9])")
LOOSE_GROUPS = re.compile(r"(?<![0-9])[0-9]{1,4}(?:[.,:\x20-][0-9]{1,4}){3}(?![0-9])")
LOOSE_SIGN = re.compile(r"@|\(at\)|\[at\]", re.I)
BEFORE_SIGN = re.compile(r"[^\s@<>\"'()\[\]]{1,64}\s?$")
AFTER_SIGN = re.compile(r"\s?[^\s@<>\"'()\[\]]{1,64}(?:\s?(?:\(dot\)|\[dot\])\s?[A-Za-z]{2,10})?")
#: Words that announce a kind, looked for in the CONTEXT characters before a span.
CUES = {"email": ("mail", "contact", "correo", "courriel"), "ip": ("ip", "host", "server", "addr"),
        "card": ("card", "visa", "pay", "karte", "carte", "tarjeta"), "phone": ("tel", "phone", "call", "fax", "mobil")}
CONTEXT = 24

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans that the fixed patterns and their tests give."""
    found: list[Span] = []
    end = 0
    for match in MAIL_END.finditer(text):
        start = match.start()
        while start > end and text[start - 1] in MAIL_LETTERS:
            start -= 1
        if start < match.start():
            found.append((start, 0, match.end()))
            end = match.end()
    for match in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.group().split(".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = digits_of(match.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
    for match in PHONE.finditer(text):
        if 9 <= len(digits_of(match.group())) <= 15:
            found.append((match.start(), 3, match.end()))
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    found: set[Span] = set()
    for match in LOOSE_NUMBER.finditer(text):
        if match.end() - match.start() <= 40:
            found.update({(match.start(), 2, match.end()), (match.start(), 3, match.end())})
    for pattern, kind in ((PLAIN_NUMBER, 2), (SPACED_NUMBER, 2), (DIALLED, 3)):
        found.update((match.start(), kind, match.end()) for match in pattern.finditer(text))
    for match in LOOSE_GROUPS.finditer(text):
        found.add((match.start(), 1, match.end()))
    for match in LOOSE_SIGN.finditer(text):
        before = BEFORE_SIGN.search(text, max(0, match.start() - 66), match.start())
        after = AFTER_SIGN.match(text, match.end(), match.end() + 90)
        if before and after:
            found.add((before.start(), 0, after.end()))
    return sorted(found)


def beside(text: str, at: int) -> int:
    """The kind of character at a place: none, white space, letter, digit, quote, other."""
    c = text[at] if 0 <= at < len(text) else ""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "\"'" else 5


def features(text: str, span: Span) -> list[int]:
    """Format and context of a candidate."""
    start, kind, end = span
    piece = text[start:end]
    runs = [len(r) for r in re.findall("[0-9]+", piece)]
    digits = digits_of(piece)
    context = text[max(0, start - CONTEXT):start].lower()
    return [kind, len(piece), len(digits), sum(map(str.isalpha, piece)), piece.count(" "), piece.count("-"),
            piece.count("."), piece.count("(") + piece.count(")"), int(piece[:1] == "+"), len(runs), max(runs, default=0),
            min(runs, default=0), int(luhn(digits)) if digits else 0,
            int(all(int(p) <= 255 for p in re.findall("[0-9]+", piece))) if len(runs) == 4 else 0,
            beside(text, start - 1), beside(text, end), piece.count("@"), piece[piece.find("@"):].count("."),
            int(any(cue in context for cue in CUES[KINDS[kind]])), int(digits[:1] or 0), len(set(digits)),
            int(text.rfind("\n", 0, start) == start - 1)]


def overlap(a: Span, b: Span) -> float:
    """Shared part of two spans over the whole of both."""
    shared = min(a[2], b[2]) - max(a[0], b[0])
    return max(0, shared) / (max(a[2], b[2]) - min(a[0], b[0]))


class Trees:
    """Boosted regression trees of fixed depth on binned features, for the log loss."""

    def __init__(self, rows: np.ndarray, right: np.ndarray, trees: int = TREES):
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
        binned = self.binned(rows)
        share = np.clip(right.mean(), 1e-3, 1 - 1e-3)
        self.start, self.nodes = float(np.log(share / (1 - share))), []
        sums = np.full(len(rows), self.start)
        for _ in range(trees):
            score = 1 / (1 + np.exp(-sums))
            tree = self.grow(binned, right - score, np.maximum(score * (1 - score), 1e-6))
            self.nodes.append(tree)
            sums += self.leaf_values(tree, binned)

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, rows.T)], axis=1)

    @staticmethod
    def grow(binned: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node, in level order, and the leaves' values."""
        inner = 2 ** DEPTH - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, BINS), np.zeros(len(binned), int)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            best = 1e-9
            whole_g, whole_h = slope[rows].sum(), curve[rows].sum()
            for f in range(binned.shape[1]):
                g = np.cumsum(np.bincount(binned[rows, f], slope[rows], BINS + 1))[:-1]
                h = np.cumsum(np.bincount(binned[rows, f], curve[rows], BINS + 1))[:-1]
                gain = g ** 2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g ** 2 / (whole_h + 1)
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, feature[n], cut[n] = gain[at], f, at
            node[rows] = 2 * n + 1 + (binned[rows, feature[n]] > cut[n])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        return feature, cut, RATE * g / (h + 1)

    @staticmethod
    def leaf_values(tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, cut, values = tree
        node, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return values[node - len(feature)]

    def sums(self, rows: np.ndarray) -> np.ndarray:
        binned = self.binned(rows)
        return self.start + sum(self.leaf_values(tree, binned) for tree in self.nodes)


class Selector:
    """Trees, their calibration and a threshold for each kind."""

    def __init__(self, rows: np.ndarray, right: np.ndarray, held: np.ndarray, trees: int = TREES):
        self.trees = Trees(rows[~held], right[~held], trees)
        sums, truth = self.trees.sums(rows[held]), right[held]
        self.slope, self.shift = self.calibrate(sums, truth)
        score, kind = self.scores(sums), rows[held, 0]
        self.least = [self.threshold(score[kind == k], truth[kind == k]) for k in range(len(KINDS))]

    @staticmethod
    def calibrate(sums: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
        """A logistic curve from sums to the share that is right, by Newton's method."""
        # each class is moved in by a pseudo-count, so that parted classes have a finite curve
        aim = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / (len(truth) - truth.sum() + 2))
        theta, x = np.array([1.0, 0.0]), np.stack([sums, np.ones(len(sums))], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            theta = theta - np.linalg.solve(hessian, x.T @ (p - aim))
        return float(theta[0]), float(theta[1])

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * sums + self.shift, -35, 35)))

    @staticmethod
    def threshold(score: np.ndarray, truth: np.ndarray) -> float:
        """The least score, 1/2 or more, from which PRECISION are right; over 1 if there is none."""
        if truth.sum() < LEAST_RIGHT:
            return 2.0
        order = np.argsort(-score, kind="stable")
        precise = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        last = np.append(score[order][1:] < score[order][:-1], True)  # ends of equal scores
        good = np.flatnonzero(last & (precise >= PRECISION) & (score[order] >= 0.5))
        return float(score[order][good[-1]]) if len(good) else 2.0

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates of the text that are selected beside its base spans."""
        fresh = [c for c in candidates(text) if not any(b[1] == c[1] and overlap(b, c) for b in base)]
        if not fresh:
            return []
        score = self.scores(self.trees.sums(np.array([features(text, c) for c in fresh])))
        taken: list[Span] = []
        for value, span in sorted(zip((-score).tolist(), fresh)):
            if -value >= self.least[span[1]] and not any(overlap(span, t) for t in taken):
                taken.append(span)
        return taken


def labelled_candidates(text: str, base: list[Span]) -> list[tuple[Span, int]]:
    return [(c, int(any(b[1] == c[1] and overlap(b, c) >= 0.8 for b in base))) for c in candidates(text)]


def learn(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> Selector | None:
    """Trees and thresholds from a bounded sample of documents; None without right and wrong candidates."""
    order = F.xxhash64(doc_id)
    ids = docs.select(F.col(doc_id).alias("_id"), order.alias("_order")).where("_id IS NOT NULL").distinct() \
        .orderBy("_order", "_id").limit(sample_docs)
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(durable(ids)), "_id", "left_semi")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py() or ""
                for (start, kind, end), right in labelled_candidates(value, base_spans(value)):
                    out.append((key, KINDS[kind], start, end, features(value, (start, kind, end)), right))
            columns = list(zip(*out)) or [()] * 6
            types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "kind", "first", "last", "features", "guess"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = chosen.mapInArrow(propose, f"doc_id {kind}, kind string, first long, last long, features array<long>, guess int")
    if labels is not None:
        rows = rows.join(labels.select("doc_id", "kind", "first", "last", F.col("label").cast("int").alias("guess_given")),
                         ["doc_id", "kind", "first", "last"]).drop("guess").withColumnRenamed("guess_given", "guess")
    mixed = F.xxhash64("doc_id", "kind", "first")
    found = durable(rows.withColumn("order", mixed).orderBy("order").limit(sample_candidates)).toArrow()
    right = found.column("guess").to_numpy()
    if not right.any() or right.all():
        return None
    order = found.column("order").to_numpy()
    by_order = np.argsort(order, kind="stable")
    table = np.array(found.column("features").to_pylist())[by_order]
    return Selector(table, right[by_order], np.arange(len(table)) % 4 == 0)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document its base spans by kind (counts and hash) and all spans, as kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text, doc_id))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selector = shared.value
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            hashes, everything = [], []
            for value in batch.column(1):
                value = value.as_py() or ""
                base = base_spans(value)
                for kind, column in enumerate(counts):
                    column.append(sum(b[1] == kind for b in base))
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                more = selector.added(value, base) if selector else []
                everything.append(written(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()),
                 pa.array(everything, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) \
        + ", base_sha256 string, spans string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(search, schema)
