"""A toxicity classifier that is held to equal scores when identity terms are swapped.

Features of a text are its words in lower case and their first letters, each once.
Those that toxic texts have far more often than others are counted over all labelled
training texts and selected. A logistic model is fitted on them. For each training
text with an identity term, the text with its terms swapped for others of the same
kind is scored as well, and the squared change of the score is part of the loss, so
that a group's mention alone does not move it.

Only the logistic fit uses a sample, so that on the driver it has a bounded input: the
selected features of at most SAMPLE_ROWS labelled rows of each class, lowest hash of the id
first, and of at most PER_FEATURE further rows of each class for every selected feature, so
that rare features are in the fit too: every weight is fitted, under the ridge and the penalty. The
ridge of a feature is at most RIDGE, and no more than RARE_RIDGE times the share of the
loss of the rows that hold it, as otherwise a large sample would leave a rare feature no
weight whatever its rows say. All texts are scored, whole.

Defined cases: null and empty texts have no features and get the score of a text
without any sign of toxicity; without labels of both classes all scores are 0; a
null id counts as an empty one and is never held out; of several labels of a document
the lowest counts; repeated rows are scored alike; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import LABEL_BYTES, id_remainder, known_labels, labelled_sample, maybe_broadcast, with_label

SAMPLE_ROWS = 20_000
FEATURES = 4096
#: A feature is looked at from so many toxic texts, and with odds this many times those of others.
LEAST_TEXTS = 3
LEAST_ODDS = 4.0
STARTS = (4, 5, 6)
TOXIC_FROM = 0.7
PENALTY = 5.0
RIDGE = 1e-4
RARE_RIDGE = 0.1
PER_FEATURE = 8
STEPS = 400
COUNTED = 200_000
WORD = re.compile(r"[^\W\d_]+")
#: Words that name a group, by kind; a word is swapped for the others of its line.
IDENTITY = [
    "women men", "woman man", "girls boys", "mothers fathers",
    "christians muslims jews hindus buddhists atheists", "christian muslim jewish hindu buddhist atheist",
    "immigrants refugees migrants natives", "gay lesbian straight bisexual transgender",
    "black white asian latino arab", "africans europeans asians americans", "disabled blind deaf autistic",
    "femmes hommes", "chrétiens musulmans juifs athées", "immigrés réfugiés migrants", "noirs blancs asiatiques arabes",
    "frauen männer", "christen muslime juden atheisten", "einwanderer flüchtlinge migranten",
    "mujeres hombres", "cristianos musulmanes judíos ateos", "inmigrantes refugiados migrantes"]
KINDS = {}
for _line in IDENTITY:
    for _term in _line.split():
        KINDS.setdefault(_term, _line.split())


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The word, and its starts behind a mark."""
    return [word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)]


def swapped(words: set[str]) -> list[set[str]]:
    """The words with identity terms moved on by one, and by two, in their kind; none without terms."""
    terms = [w for w in words if w in KINDS]
    out = []
    for by in (1, 2) if terms else ():
        other = {t: KINDS[t][(KINDS[t].index(t) + by) % len(KINDS[t])] for t in terms}
        moved = {other.get(w, w) for w in words}
        if moved != words and moved not in out:
            out.append(moved)
    return out


def feature_counts(training: DataFrame) -> DataFrame:
    """(_feature, _toxic, _clean): in how many labelled texts of either class it occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def rows() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1].get(x, 0) for x in names], pa.int64()),
                 pa.array([counts[0].get(x, 0) for x in names], pa.int64())], ["_feature", "_toxic", "_clean"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                seen = counts[label]
                for feature in {f for word in words_of(text.as_py() or "") for f in features_of(word)}:
                    seen[feature] = seen.get(feature, 0) + 1
                if len(counts[0]) + len(counts[1]) > COUNTED:
                    yield rows()
        yield rows()

    return training.select("_text", "_label").mapInArrow(count, "_feature string, _toxic long, _clean long") \
        .groupBy("_feature").agg(F.sum("_toxic").alias("_toxic"), F.sum("_clean").alias("_clean"))


def selected(training: DataFrame, features: int = FEATURES) -> list[str]:
    """The features whose odds speak most surely for toxicity."""
    classes = {r["_label"]: r["count"] for r in training.groupBy("_label").count().collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    if not toxic or not clean:
        return []
    odds = F.log((F.col("_toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("_clean") + 0.5) / (clean + 1.0))
    return [r["_feature"] for r in feature_counts(training).where(F.col("_toxic") >= LEAST_TEXTS)
            .withColumn("_odds", odds).where(F.col("_odds") >= float(np.log(LEAST_ODDS)))
            .orderBy((F.col("_odds") * F.sqrt("_toxic")).desc(), "_feature").limit(features).collect()]


class Finder(dict):
    """Word to the numbers of its selected features; fills itself, and is emptied when large."""

    def __init__(self, features: list[str], size: int = 300_000):
        super().__init__()
        self.numbers, self.size = {f: i for i, f in enumerate(features)}, size

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.size:
            self.clear()
        found = tuple(self.numbers[f] for f in features_of(word) if f in self.numbers)
        if len(word) <= 64:
            self[word] = found
        return found

    def numbers_of(self, words: set[str]) -> list[int]:
        return sorted({i for word in words for i in self[word]})


def sparse_rows(training: DataFrame, features: list[str]) -> DataFrame:
    """(id, label, own, other): per labelled text its features, and those of its swapped forms; texts without
    either are of one kind and stay too, as they set the intercept."""
    shared = training.sparkSession.sparkContext.broadcast(features)
    kind = training.schema["_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            own, other = [], []
            for text in batch.column(0):
                words = words_of(text.as_py() or "")
                own.append(finder.numbers_of(words))
                other.append([finder.numbers_of(w) for w in swapped(words)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32())))],
                ["id", "label", "own", "other"])

    return training.select("_text", "_id", "_label").mapInArrow(
        find, f"id {kind}, label int, own array<int>, other array<array<int>>")


def fit_rows(rows: DataFrame, ids: DataFrame, per_feature: int = PER_FEATURE) -> pa.Table:
    """The rows to fit: those of ``ids``, and for every feature and class the ``per_feature`` with the lowest
    hash of the id among all that hold it, be it as they stand or with terms swapped.

    The limit per feature is applied in each task before the shuffle.
    """
    held = F.explode(F.array_distinct(F.concat("own", F.flatten("other"))))
    lowest = Window.partitionBy("feature", "label").orderBy(F.xxhash64("id"), "id")
    extra = rows.select("id", "label", held.alias("feature")).withColumn("nth", F.row_number().over(lowest)) \
        .where(F.col("nth") <= per_feature).select("id")
    chosen = durable(ids.select(F.col("_id").alias("id")).unionByName(extra).distinct())
    sample = rows.join(maybe_broadcast(chosen, chosen.count(), LABEL_BYTES), "id", "left_semi")
    # an id counts once, so that repeated rows cannot swell what the driver gets
    return sample.groupBy("id", "label").agg(F.min(F.struct("own", "other")).alias("of")).select(
        "label", "of.own", "of.other").toArrow()


class Sparse:
    """Rows of feature numbers."""

    def __init__(self, rows: list[list[int]], size: int):
        self.size, self.count = size, len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([i for r in rows for i in r], np.int64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.count)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.size)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Loss:
    """Log loss with both classes of equal weight, ridge, and the penalty on changes of score over pairs."""

    def __init__(self, own: list[list[int]], labels: np.ndarray, pairs: list[tuple[int, list[int]]], size: int,
                 penalty: float):
        self.x, self.moved = Sparse(own, size), Sparse([p[1] for p in pairs], size)
        self.origin = np.array([p[0] for p in pairs], np.int64)
        self.labels, self.penalty = labels, penalty
        # both classes weigh the same, whatever their shares of the sample
        self.balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        self.ridge = np.minimum(RIDGE, RARE_RIDGE * self.x.back(self.balance))

    def slope(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Derivatives by each weight, then by the intercept."""
        score = squash(self.x.times(weights) + bias)
        pull = self.balance * (score - self.labels)
        out = np.append(self.x.back(pull) + self.ridge * weights, pull.sum())
        if len(self.origin):
            before, after = score[self.origin], squash(self.moved.times(weights) + bias)
            change = 2 * self.penalty * (after - before) / len(self.origin)
            up, down = change * after * (1 - after), -change * before * (1 - before)
            fall = np.bincount(self.origin, down, self.x.count)
            out += np.append(self.moved.back(up) + self.x.back(fall), up.sum() + down.sum())
        return out


def fit(own: list[list[int]], labels: np.ndarray, pairs: list[tuple[int, list[int]]], size: int,
        penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss, ridge, and ``penalty`` times the mean squared
    change of score over pairs (row, features of its swapped form)."""
    loss = Loss(own, labels, pairs, size, penalty)
    weights, bias = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        slope = loss.slope(weights, bias)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        move = 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def learn(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, penalty: float = PENALTY,
          sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, float]:
    known = durable(known_labels(labels, "toxic", id_remainder("doc_id", 3) != 1))
    training = durable(with_label(docs, known, text, doc_id, "inner"))
    features = selected(training)
    if not features:
        return [], np.zeros(0), -np.inf
    rows = fit_rows(durable(sparse_rows(training, features)), labelled_sample(known, sample_rows))
    own = rows.column("own").to_pylist()
    pairs = [(i, other) for i, others in enumerate(rows.column("other").to_pylist()) for other in others]
    toxic = rows.column("label").to_numpy()
    weights, bias = fit(own, toxic, pairs, len(features), penalty)
    return features, weights, bias


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          penalty: float = PENALTY) -> DataFrame:
    """Per document doc_id, held_out, score and predicted."""
    features, weights, bias = learn(docs, labels, text, doc_id, penalty)
    shared = docs.sparkSession.sparkContext.broadcast((features, weights, bias))
    kind = docs.schema[doc_id].dataType.simpleString()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, start = shared.value
        finder = Finder(names)
        for batch in batches:
            sums = [start + float(table[finder.numbers_of(words_of(text.as_py() or ""))].sum()) if names else start
                    for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(squash(np.array(sums, float)) if names
                                              else np.zeros(len(sums)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), (id_remainder(doc_id, 3) == 1).alias("held_out"),
                       F.col(text).alias("_text"))
    return rows.mapInArrow(tell, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0))
