"""Language of a text in two steps: the family first, then the language within it.

Both steps are linear support vector machines, one for each pair of classes, over hashed
character n-grams; pairs vote. Closely related languages are only held against each other, by
machines that were fitted on them alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import common

#: Language codes by family; a language not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
}
#: About so many labelled rows of each language are used to fit.
SAMPLE = 250
SIZE = 4096
GRAMS = (1, 2, 3)
UNKNOWN = "und"
#: Margins are divided by this before they become a score.
SCALE = 0.25
_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
_LETTER = regex.compile(r"\p{L}")


def family(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language in codes), language)


def features(text: str) -> np.ndarray | None:
    """Unit vector of damped counts of hashed n-grams of the whole text; None without a letter."""
    if not _LETTER.search(text):
        return None
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(SIZE)
    for n, factor in zip(GRAMS, _FACTORS, strict=True):
        total = codes[: len(codes) - n + 1] * np.uint32(factor)
        for i in range(1, n):
            total = (total ^ (total >> np.uint32(15))) * np.uint32(factor) + codes[i : len(codes) - n + 1 + i]
        total = (total ^ (total >> np.uint32(13))) * np.uint32(_FACTORS[0])
        counts += np.bincount(total >> np.uint32(20), minlength=SIZE)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


class PairMachines:
    """Linear machines for all pairs of classes, by majority of votes."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        y = np.array([self.classes.index(c) for c in labels])
        fits = [_machine(x[(y == a) | (y == b)], y[(y == a) | (y == b)] == a) for a, b in self.pairs]
        self.weights = np.array([w for w, _ in fits], np.float32).reshape(len(fits), x.shape[1]).T
        self.offsets = np.array([b for _, b in fits], np.float32)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the class and how sure its closest pair is, 0.5 to 1."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights + self.offsets
        votes = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            sure = 1 / (1 + np.exp(-np.clip(margins[:, k] / SCALE, -30, 30)))
            votes[:, a] += (margins[:, k] >= 0) + sure / 1000
            votes[:, b] += (margins[:, k] < 0) + (1 - sure) / 1000
        best = votes.argmax(axis=1)
        least = np.full(len(x), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            side = np.where(best == a, margins[:, k], np.where(best == b, -margins[:, k], np.inf))
            least = np.minimum(least, side)
        return best, 1 / (1 + np.exp(-np.clip(least / SCALE, -30, 30)))


def _machine(x: np.ndarray, positive: np.ndarray, cost: float = 20.0, rounds: int = 150):
    """Squared hinge loss with a ridge, by accelerated gradient steps; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    sign = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    step = 1 / (1 + 4 * cost)  # rows are of length sqrt(2), weights of rows sum to 1
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        gap = np.maximum(0, 1 - sign * (x @ ahead))
        gradient = ahead - 2 * cost * ((share * sign * gap) @ x)
        new = ahead - step * gradient
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], w[-1]


class LanguageModel:
    """The machines for families and, in each family, for its languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        families = [family(c) for c in languages]
        self.top = PairMachines(x, families)
        self.within = {}
        for name in self.top.classes:
            own = [i for i, f in enumerate(families) if f == name]
            self.within[name] = PairMachines(x[own], [languages[i] for i in own])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top, sure = self.top.decide(x)
        names, score = [""] * len(x), sure.copy()
        for k, name in enumerate(self.top.classes):
            rows = np.flatnonzero(top == k)
            if len(rows):
                best, inner = self.within[name].decide(x[rows])
                score[rows] *= inner
                for row, c in zip(rows, best, strict=True):
                    names[row] = self.within[name].classes[c]
        return names, score


def fit(
    spark: SparkSession,
    docs: DataFrame,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> LanguageModel | None:
    """Machines fitted on about `sample` rows of each language, chosen by a hash of the id.

    NULL languages and texts without a letter teach nothing; without any row there is no model.
    At most two times `sample` vectors of `SIZE` half floats per language reach the driver.
    """
    common.small_batches(spark)
    labelled = docs.select(
        F.col(common.plain(id_column)).alias("doc_id"),
        common.blob(F.col(common.plain(text_column))).alias("body"),
        F.col(common.plain(language_column)).alias("lang"),
    ).where("lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for language, count in counts.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, sample / count))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)
    chosen = labelled.where(drawn).mapInArrow(_vectors, "lang string, vector binary").collect()
    chosen = sorted((r["lang"], bytes(r["vector"])) for r in chosen)
    if not chosen:
        return None
    x = np.array([np.frombuffer(v, np.float16) for _, v in chosen], np.float32)
    return LanguageModel(x, [c for c, _ in chosen])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "body", 4_000_000):
        rows = zip(batch.column("lang").to_pylist(), batch.column("body"), strict=True)
        made = [(c, features(x.as_py().decode())) for c, x in rows]
        made = [(c, v.astype(np.float16).tobytes()) for c, v in made if v is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in made], pa.string()), pa.array([v for _, v in made], pa.binary())],
            names=["lang", "vector"],
        )


def predict(
    docs: DataFrame,
    model: LanguageModel | None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, lang_pred, score, from the whole text alone.

    `und` with score 0 for NULL texts, texts without a letter, and if there is no model. Each
    row is judged alone, so repeated rows get equal results. Other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(
        F.col(common.plain(id_column)).alias("doc_id"),
        common.blob(F.col(common.plain(text_column))).alias("body"),
    )
    identity = texts.schema["doc_id"].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "body", 2_000_000):
            names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            made = [features(x.as_py().decode()) if model else None for x in batch.column("body")]
            some = [i for i, v in enumerate(made) if v is not None]
            for start in range(0, len(some), 500):
                rows = some[start : start + 500]
                found, sure = model.predict(np.array([made[i] for i in rows]))
                for i, name, value in zip(rows, found, sure, strict=True):
                    names[i], score[i] = name, value
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return texts.mapInArrow(judged, f"doc_id {identity}, lang_pred string, score double")


def held_out(doc_id: str | Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from the fit: crc32 of the id as text, modulo `folds`, is `fold`."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rest = F.crc32(column.cast("string").cast("binary")) % folds
    return F.coalesce(rest == fold, F.lit(False))
