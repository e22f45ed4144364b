"""Toxicity of a text by a support vector machine over a subsequence string kernel.

Two words are alike by the letters they share in order, three at a time, with gaps: a shared
subsequence counts `DECAY` to the power of the steps that it spans in either word. A letter put
in, left out or doubled changes only the subsequences over it. The normalised kernel is raised to
`POWER`. A sentence is as like a landmark as its most alike word; landmarks are the words that go
with label 1 most, and the Nyström map turns these likenesses into features of a linear machine.

The machine is fitted on sentences. A clean text gives clean sentences; of a toxic text only the
sentence that the machine of the round before finds worst is taken as toxic. A text scores by its
`WORST` worst sentences, whose margins become a probability at the shares of the labels.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch

#: About so many labelled texts of each label are used to fit.
SAMPLE = 3000
LANDMARKS = 64
DECAY, POWER = 0.8, 4
#: Steps from one letter of a subsequence to the next, at most: up to three letters may stand between.
GAP = 4
#: Letters of a window, its two edges included, and how far the next one starts in a long word.
WIDEST, STEP = 24, 8
#: Sentences of a text that the fit looks at, the worst so far, and those that count.
LOOKED_AT, WORST = 6, 3
#: Passes over the sample, each with the weights of the one before, and choices of sentences in each.
PASSES, ROUNDS = 2, 3
#: From this score on a text is taken as toxic.
LIMIT = 0.3
#: Likenesses of a word under this count as none; words in a sentence at most.
LEAST, PIECE = 0.01, 30
#: Weight of the errors against the size of the machine.
COST = 5.0
_EDGE = "\x02"
_CLASSES = 100
#: Single letters set apart stand for one word.
_APART = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = (".", "!", "?")


def windows(word: str) -> list[str]:
    """The word between edges; a long one in overlapping windows that cover all of it."""
    core = _OUTER.sub("", word) or word
    whole = f"{_EDGE}{core}{_EDGE}"
    if len(whole) <= WIDEST:
        return [whole]
    last = len(whole) - WIDEST
    return [whole[at : at + WIDEST] for at in [*range(0, last, STEP), last]]


@functools.cache
def _triples(length: int) -> tuple[np.ndarray, ...]:
    """Places of all subsequences of three, and their weights."""
    steps = itertools.product(range(length), range(1, GAP + 1), range(1, GAP + 1))
    places = [(i, i + a, i + a + b) for i, a, b in steps if i + a + b < length]
    i, j, k = np.array(places, np.int64).reshape(-1, 3).T
    return i, j, k, (DECAY ** (k - i)).astype(np.float32)


@functools.cache
def _decay(length: int) -> np.ndarray:
    """From each place to the next `GAP` ones."""
    gap = np.subtract.outer(np.arange(length), np.arange(length)).T
    return np.where((gap > 0) & (gap <= GAP), DECAY ** np.maximum(gap, 0), 0.0).astype(np.float32)


def norms(codes: np.ndarray) -> np.ndarray:
    """Kernel of every row of letters with itself, as its square root."""
    decay = _decay(codes.shape[1])
    alike = (codes[:, :, None] == codes[:, None, :]).astype(np.float32)
    total = alike
    for _ in range(2):
        total = alike * (decay.T @ (total @ decay))
    return np.sqrt(total.sum(axis=(1, 2)))


class Kernel:
    """Kernel values of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        wrapped = [windows(w)[0] for w in landmarks]
        # letters of landmarks by class; beyond _CLASSES - 1 they share classes by their code
        letters = sorted(set("".join(wrapped)))
        self.classes = {c: 1 + k if k < _CLASSES - 1 else 1 + ord(c) % (_CLASSES - 1) for k, c in enumerate(letters)}
        features: dict[int, np.ndarray] = {}
        for m, word in enumerate(wrapped):
            codes = self._codes([word])
            i, j, k, weight = _triples(len(word))
            keys = (codes[0, i] * _CLASSES + codes[0, j]) * _CLASSES + codes[0, k]
            own = weight / norms(codes)[0]
            for key, value in zip(keys.tolist(), own, strict=True):
                features.setdefault(key, np.zeros(len(wrapped), np.float32))[m] += value
        #: By key, the number of its feature (0: none); by feature, its landmarks and values there.
        self.place = np.zeros(_CLASSES**3, np.int32)
        self.place[list(features)] = np.arange(1, len(features) + 1)
        held = [np.flatnonzero(row) for row in features.values()]
        self.count = np.array([0, *map(len, held)])
        self.first = np.cumsum(self.count) - self.count
        self.mark = np.concatenate([*held, np.zeros(0, np.int64)])
        self.value = np.concatenate([*(row[at] for row, at in zip(features.values(), held, strict=True)), np.zeros(0)]).astype(np.float32)

    def _codes(self, words: list[str]) -> np.ndarray:
        """Classes of letters of words of one length; letters of no landmark stand above them."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        known, back = np.unique(flat, return_inverse=True)
        classes = np.array([self.classes.get(chr(c), _CLASSES + c) for c in known.tolist()], np.int64)
        return classes[back].reshape(len(words), -1)

    def of_windows(self, words: list[str]) -> np.ndarray:
        """Likenesses of windows with each landmark; those under `LEAST` are 0."""
        many = len(self.landmarks)
        out = np.zeros((len(words), many), np.float32)
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_length.setdefault(len(word), []).append(at)
        for length, rows in by_length.items():
            i, j, k, weight = _triples(length)
            step = max(1, 30_000 // max(1, len(weight)))
            for start in range(0, len(rows) if length > 2 else 0, step):
                some = rows[start : start + step]
                codes = self._codes([words[r] for r in some])
                small = np.where(codes < _CLASSES, codes, 0)
                keys = (small * _CLASSES**2).take(i, 1) + (small * _CLASSES).take(j, 1) + small.take(k, 1)
                feature = self.place.take(keys).ravel()
                hits = np.flatnonzero(feature)
                feature = feature.take(hits)
                row = hits // len(weight)
                count = self.count.take(feature)
                # one entry for each landmark of each feature found
                entry = np.repeat(np.arange(len(hits)), count)
                at = np.arange(len(entry)) + (self.first.take(feature) - np.cumsum(count) + count).take(entry)
                cell = (row * many).take(entry) + self.mark.take(at)
                value = weight.take(hits - row * len(weight)).take(entry) * self.value.take(at)
                sums = np.bincount(cell, value, len(some) * many)
                out[some] = sums.reshape(-1, many) / norms(codes)[:, None]
        out = np.minimum(out, 1) ** POWER
        out[out < LEAST] = 0
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Likeness of each word: that of its most alike window."""
        parts = [windows(w) for w in words]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        number: dict[str, int] = {}
        at = [number.setdefault(w, len(number)) for part in parts for w in part]
        return np.maximum.reduceat(self.of_windows(list(number))[at], starts)


class Likeness:
    """Sentences of texts as rows of likenesses. Words met before are not computed again.

    About `most` words are held at most, and those of one call.
    """

    def __init__(self, kernel: Kernel, most: int = 500_000):
        self.kernel, self.most = kernel, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        #: Of every word, whether it ends a sentence, and its row; words like no landmark have none.
        self.ends, self.row = np.zeros(0, bool), np.zeros(0, np.int64)
        self.rows = np.zeros((0, len(self.kernel.landmarks)), np.float32)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if not new:
            return
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        likeness = self.kernel.of_words(new)
        some = likeness.any(axis=1)
        rows = np.where(some, len(self.rows) + np.cumsum(some) - 1, -1)
        self.row = np.append(self.row, rows)
        self.rows = np.vstack([self.rows, likeness[some]])
        self.ends = np.append(self.ends, [w.endswith(_ENDS) for w in new])

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sentences with a word like a landmark: the place of the text, and likenesses.

        A sentence ends with a line, with `.!?`, and after `PIECE` words; words are never cut.
        """
        if len(self.number) > self.most:
            self._clear()
        words: list[str] = []
        lines, firsts = [], []
        for text in texts:
            firsts.append(len(words))
            for line in _APART.sub(lambda m: "".join(m.group().split()), text.lower()).split("\n"):
                lines.append(len(words))
                words += line.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros((0, len(self.kernel.landmarks)), np.float32)
        self._learn(words)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        begins = np.zeros(len(at) + 1, bool)
        begins[lines] = begins[0] = True
        begins[1:] |= self.ends[at]
        begins = begins[:-1]
        within = np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        sentence = np.cumsum(within % PIECE == 0)
        alike = np.flatnonzero(self.row[at] >= 0)
        starts = np.flatnonzero(np.diff(sentence[alike], prepend=-1))
        rows = self.rows[self.row[at[alike]]]
        found = np.maximum.reduceat(rows, starts) if len(starts) else rows
        return np.searchsorted(firsts, alike[starts], side="right") - 1, found


class ToxicityModel:
    """Landmarks, their weights, and how the margins of the worst sentences become a probability."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, offset: float, curve: np.ndarray):
        self.landmarks, self.weights, self.offset, self.curve = landmarks, weights, offset, curve

    def worst(self, texts: int, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The `WORST` highest margins of every text, the highest first."""
        out = np.full((texts, WORST), self.offset)
        margins = rows @ self.weights + self.offset
        order = np.lexsort((-margins, place))
        rank = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        top = order[rank < WORST]
        out[place[top], rank[rank < WORST]] = np.maximum(margins[top], self.offset)
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(worst @ self.curve[:-1] + self.curve[-1], -30, 30)))


def nystrom(kernel: Kernel) -> np.ndarray:
    """From likenesses to features whose products are the kernel, on the span of the landmarks."""
    values, vectors = np.linalg.eigh(kernel.of_words(kernel.landmarks).astype(np.float64))
    kept = values > 1e-4 * values.max()
    return vectors[:, kept] / np.sqrt(values[kept])


def machine(x: np.ndarray, positive: np.ndarray, cost: float = COST, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps; labels weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    step = 1 / (1 + 2 * cost * np.linalg.eigvalsh((x * share[:, None]).T @ x)[-1])
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        gap = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - step * (ahead - 2 * cost * ((share * sign * gap) @ x))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def calibrated(x: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic curve through weighted rows, by Newton steps with a small ridge; the shift is last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - positive)) + 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def fit(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample: int = SAMPLE,
) -> ToxicityModel | None:
    """A model from the texts whose id is labelled 0 or 1.

    About `sample` ids of each label are chosen by a hash of the id. An id with several labels
    is toxic if any says so, and of its rows one text teaches; NULL ids, labels and texts teach
    nothing. Without texts of both labels there is no model. At most about twice `sample` ids,
    `LOOKED_AT` rows of `LANDMARKS` numbers for each, and the landmarks reach the driver.
    """
    common.small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    known = (
        labels.select(F.col(common.plain(id_column)).alias("doc_id"), F.col(common.plain(label_column)).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    known = scratch.cut("labels", known)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return None
    share = F.when(F.col("label") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(common.plain(id_column)).alias("doc_id"), F.col(common.plain(text_column)).alias("text"))
    # about twice `sample` ids, whatever the input
    chosen = texts.where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label")
    chosen = scratch.cut("sample", chosen.agg(F.max("text").alias("text")))
    # a quarter of the texts only sets the probabilities, unless that leaves a label without texts
    chosen = chosen.withColumn("late", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0)
    found = {(r["late"], r["label"]): r["count"] for r in chosen.groupBy("late", "label").count().collect()}
    if not all((late, label) in found for late in (True, False) for label in (0, 1)):
        chosen = chosen.withColumn("late", F.lit(None).cast("boolean"))
    early, late = (chosen.where(F.coalesce(F.col("late") == x, F.lit(True))) for x in (False, True))
    rows = {r["label"]: r["count"] for r in early.groupBy("label").count().collect()}
    if set(rows) != {0, 1}:
        return None
    landmarks = _landmarks(early, rows)
    if not landmarks:
        return None
    features = nystrom(Kernel(landmarks))
    weights, offset, clean = np.ones(len(landmarks)), 0.0, np.zeros((0, len(landmarks)))
    for _ in range(PASSES):
        bags, positive = _bags(early, landmarks, weights)
        clean = np.vstack([clean, *(bag for bag, p in zip(bags, positive, strict=True) if not p)])
        toxic = [bag for bag, p in zip(bags, positive, strict=True) if p]
        weights, offset = _fitted(clean, toxic, features, weights)
    bags, positive = _bags(late, landmarks, weights)
    model = ToxicityModel(landmarks, weights, offset, np.zeros(WORST + 1))
    place = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    prior = np.where(positive, counts[1] / positive.sum(), counts[0] / (~positive).sum())
    worst = model.worst(len(bags), place, np.vstack(bags))
    model.curve = calibrated(worst, positive, prior * len(prior) / prior.sum())
    return model


def _bags(chosen: DataFrame, landmarks: list[str], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The worst sentences by some weights, for each text of the sample, and which are toxic."""
    bodies = chosen.select(F.col("doc_id").cast("string"), "label", common.blob("text").alias("body"))
    found = bodies.mapInArrow(_worst_of(landmarks, weights), "doc_id string, label int, rows binary").collect()
    found = sorted((r["doc_id"], r["label"], bytes(r["rows"])) for r in found)
    bags = [np.frombuffer(r, np.float32).reshape(-1, len(landmarks)).astype(np.float64) for _, _, r in found]
    return bags, np.array([c == 1 for _, c, _ in found])


def _fitted(clean: np.ndarray, bags: list[np.ndarray], features: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of likenesses: of a toxic text, the worst sentence by the round before teaches."""
    offset = 0.0
    for _ in range(ROUNDS):
        toxic = np.array([bag[(bag @ weights).argmax()] for bag in bags])
        x = np.vstack([clean, toxic]) @ features
        w, offset = machine(x, np.arange(len(x)) >= len(clean))
        weights = features @ w
    return weights, offset


def _landmarks(chosen: DataFrame, rows: dict[int, int]) -> list[str]:
    """The words that go with label 1 most, by a likelihood ratio over texts."""
    words = chosen.select(
        "label", F.explode(F.array_distinct(F.transform(
            F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        ))).alias("word"),
    ).where(F.char_length("word").between(3, WIDEST - 2))
    counted = words.groupBy("word").agg(
        F.sum("label").cast("double").alias("toxic"), F.sum(1 - F.col("label")).cast("double").alias("clean")
    )
    total = rows[0] + rows[1]
    seen = F.col("toxic") + F.col("clean")

    def part(count: Column, texts: int) -> Column:
        """Both halves of the ratio for the texts of one label: with the word and without."""
        expected = seen * texts / total
        missing, unexpected = texts - count, texts - expected
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0) + F.when(
            (missing > 0) & (unexpected > 0), missing * F.log(missing / unexpected)
        ).otherwise(0.0)

    ratio = F.round(part(F.col("toxic"), rows[1]) + part(F.col("clean"), rows[0]), 6)
    best = counted.where(F.col("toxic") * rows[0] > F.col("clean") * rows[1])
    return [r["word"] for r in best.orderBy(F.desc(ratio), "word").limit(LANDMARKS).collect()]


def _worst_of(landmarks: list[str], weights: np.ndarray) -> Callable:
    """Per text the likenesses of its `LOOKED_AT` worst sentences by some weights."""

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = Likeness(Kernel(landmarks))
        for batch in common.slices(batches, "body", 2_000_000):
            place, rows = likeness.sentences([x.as_py().decode() for x in batch.column("body")])
            order = np.lexsort((-(rows @ weights), place))
            bounds = np.searchsorted(place[order], np.arange(batch.num_rows + 1))
            none = np.zeros((1, len(landmarks)), np.float32)
            out = [
                (rows[order[a : min(b, a + LOOKED_AT)]] if b > a else none).tobytes()
                for a, b in itertools.pairwise(bounds)
            ]
            made = [batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "label", "rows"])

    return worst


def score(
    docs: DataFrame, model: ToxicityModel | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, score, predicted, from the whole text alone.

    `score` is the probability of label 1, `predicted` whether it is `LIMIT` or more. NULL texts,
    empty ones and those without words score as sentences that are like no landmark; without a
    model every score is 0. Each row is judged alone, so repeated rows get equal results. Other
    columns are not read.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(
        F.col(common.plain(id_column)).alias("doc_id"),
        common.blob(F.col(common.plain(text_column))).alias("body"),
    )
    identity = texts.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = Likeness(Kernel(model.landmarks)) if model else None
        for batch in common.slices(batches, "body", 2_000_000):
            values = np.zeros(batch.num_rows)
            if model:
                found = likeness.sentences([x.as_py().decode() for x in batch.column("body")])
                values = model.probability(model.worst(batch.num_rows, *found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values), pa.array((values >= LIMIT).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return texts.mapInArrow(scored, f"doc_id {identity}, score double, predicted int")
