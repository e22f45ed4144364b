"""Hard negatives by an exact search in a multiway tree over all vectors.

The tree is a near-neighbour access tree in two levels: each level has up to `FAN` split points,
far apart from each other, and a vector belongs to the nearest one (so regions are bounded by
hyperplanes). Every split point stores, for each sibling subtree, the range of its distances to
the vectors there. Below a leaf, vectors lie sorted by their distance to its split point, in
chunks that store the same ranges. A search is a window of scores; for a subtree it is an
annulus around the anchor, and the subtree is left out if, for any split point, no distance of
its range can fall into that annulus. Chunks that stay are scored exactly.

The split points come from a bounded sample; every vector is indexed, and the ranges are those
of all vectors, so results are exact whatever the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch

#: Split points of a level; vectors of which the split points are chosen, about; vectors of the
#: sample that a split point of the lower level needs.
FAN, SAMPLE, LEAST = 16, 4096, 16
#: Vectors of a chunk, and anchors of a block, at most.
CHUNK, ANCHORS = 1024, 64
#: Components are floor(SCALE * x).
SCALE = 256
#: Scores end here.
_LOW, _HIGH = -(1 << 62), 1 << 62


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows."""
    square = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` rows, each the farthest one from those before it; equal rows count once."""
    chosen, nearest = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class SplitTree:
    """Split points of both levels. Leaves are numbered through."""

    def __init__(self, sample: np.ndarray):
        self.top = far_apart(sample, FAN)
        region = distances(sample, self.top).argmin(axis=1)
        self.low, self.parent, self.first = [], [], []
        for k in range(len(self.top)):
            own = sample[region == k]
            count = min(FAN, len(own) // LEAST)
            self.first.append(len(self.parent))
            self.low.append(far_apart(own, count) if count > 1 else self.top[k : k + 1])
            self.parent += [k] * len(self.low[-1])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of every row and its distance to the split point of the leaf."""
        region = distances(x, self.top).argmin(axis=1)
        leaf, away = np.zeros(len(x), np.int32), np.zeros(len(x))
        for k in np.unique(region):
            rows = np.flatnonzero(region == k)
            d = distances(x[rows], self.low[k])
            leaf[rows], away[rows] = self.first[k] + d.argmin(axis=1), d.min(axis=1)
        return leaf, away

    def to_points(self, x: np.ndarray, leaf: int) -> np.ndarray:
        """Distances to all split points beside the way to a leaf: the top ones, its siblings."""
        return distances(x, np.vstack([self.top, self.low[self.parent[leaf]]]))


class Ranges:
    """Distance ranges of a subtree to split points, and the range of its squared norms."""

    def __init__(self, low, high, least: float, most: float):
        self.low, self.high, self.least, self.most = np.asarray(low), np.asarray(high), least, most

    def scores(self, square: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each anchor, given its squared norm and distances."""
        nearest = np.maximum(np.maximum(away - self.high, self.low - away), 0).max(axis=1)
        farthest = (away + self.high).min(axis=1)
        slack = 1 + 1e-6 * (square + self.most)
        lowest = (square + self.least - farthest**2) / 2 - slack
        return lowest, (square + self.most - nearest**2) / 2 + slack


class VectorIndex:
    """All vectors of a table in chunks under a split tree.

    `vectors` has row (a number of its own), id, label (text), vector (array of numbers) and
    anchor (boolean). Rows without id, label or vector, or with a NULL or non-finite component,
    take no part. Shorter vectors count as filled up with zeros.
    """

    def __init__(self, spark: SparkSession, vectors: DataFrame):
        common.small_batches(spark)
        self.spark, self.scratch = spark, Scratch(spark, "vectors")
        number = lambda x: x.cast("double")
        sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(number(x)) < float("inf")))
        valid = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound)
        size = valid.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"),
            F.coalesce(F.max(F.array_max(F.transform("vector", lambda x: F.abs(number(x))))), F.lit(0.0)).alias("most"),
        ).first()
        self.rows, self.width = size["rows"], max(1, size["width"])
        largest = size["most"] * SCALE + 1
        # whole numbers below 2^24 are exact in four bytes, products below 2^53 in eight
        self.kind = "<f4" if largest < 1 << 24 else "<f8"
        self.exact = largest * largest * self.width < 1 << 53
        share = min(1.0, SAMPLE / self.rows) if self.rows else 1.0
        drawn = F.pmod(F.xxhash64("row", F.lit(13)), F.lit(1 << 20)) < share * (1 << 20)
        packed = valid.mapInArrow(_packer(self.width, self.kind), "row bigint, id bigint, label string, anchor boolean, v binary")
        sample = sorted(bytes(r["v"]) for r in packed.where(drawn).select("v").collect())
        self.tree = SplitTree(self._matrix(b"".join(sample))) if sample else None
        if self.tree is None:
            return
        assigned = self.scratch.cut("assigned", packed.mapInArrow(self._assigner(), packed.schema.simpleString()[7:-1] + ", leaf int, away double"))
        sort = ["leaf", "away", "id", "row"]
        ordered = assigned.repartitionByRange(*sort).sortWithinPartitions(*sort)
        self.chunks = self.scratch.cut(
            "chunks",
            ordered.mapInArrow(
                self._chunker(),
                "leaf int, ids binary, rows binary, labels array<string>, vectors binary, "
                "low array<double>, high array<double>, least double, most double",
            ).withColumn("chunk", F.monotonically_increasing_id()),
        )
        anchors = assigned.where("anchor").repartitionByRange(*sort).sortWithinPartitions(*sort)
        self.blocks = self.scratch.cut(
            "anchors",
            anchors.mapInArrow(
                self._blocker(), "ids binary, rows binary, labels array<string>, vectors binary, homes binary"
            ).withColumn("block", F.monotonically_increasing_id()),
        )
        self._summarise()

    def _matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.width).astype(np.float64)

    def _summarise(self) -> None:
        """Ranges of every leaf, and its chunks as runs of numbers: leaves and tasks many, at most."""
        flat = self.chunks.select("leaf", "least", "most", F.posexplode(F.arrays_zip("low", "high")).alias("point", "range"))
        found = flat.groupBy("leaf", "point").agg(
            F.min("range.low").alias("low"), F.max("range.high").alias("high"),
            F.min("least").alias("least"), F.max("most").alias("most"),
        ).orderBy("leaf", "point")
        by_leaf: dict[int, list] = {}
        for r in found.collect():
            by_leaf.setdefault(r["leaf"], []).append(r)
        self.ranges = {
            leaf: Ranges([r["low"] for r in rs], [r["high"] for r in rs], rs[0]["least"], rs[0]["most"])
            for leaf, rs in by_leaf.items()
        }
        runs = self.chunks.groupBy("leaf", F.shiftright("chunk", 33).alias("part")).agg(
            F.min("chunk").alias("first"), F.count(F.lit(1)).alias("n")
        )
        self.spans: dict[int, list[tuple[int, int]]] = {}
        for r in runs.collect():
            self.spans.setdefault(r["leaf"], []).append((r["first"], r["n"]))

    def _assigner(self) -> Callable:
        tree, matrix = self.tree, self._reader()

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                leaf, away = tree.leaves(matrix(b"".join(batch.column("v").to_pylist())))
                made = [*batch.columns, pa.array(leaf), pa.array(away)]
                yield pa.RecordBatch.from_arrays(made, names=[*batch.schema.names, "leaf", "away"])

        return assigned

    def _reader(self) -> Callable[[bytes], np.ndarray]:
        width, kind = self.width, self.kind
        return lambda data: np.frombuffer(data, kind).reshape(-1, width).astype(np.float64)

    def _chunker(self) -> Callable:
        tree, matrix = self.tree, self._reader()

        def made(rows: list[dict]) -> dict:
            data = b"".join(r["v"] for r in rows)
            x, leaf = matrix(data), rows[0]["leaf"]
            away, square = tree.to_points(x, leaf), (x**2).sum(axis=1)
            return {
                "leaf": leaf, "ids": _longs(r["id"] for r in rows), "rows": _longs(r["row"] for r in rows),
                "labels": [r["label"] for r in rows], "vectors": data,
                "low": away.min(axis=0).tolist(), "high": away.max(axis=0).tolist(),
                "least": float(square.min()), "most": float(square.max()),
            }

        schema = pa.schema(
            [("leaf", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.list_(pa.string())),
             ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
             ("least", pa.float64()), ("most", pa.float64())]
        )
        return lambda batches: _runs(batches, lambda r: r["leaf"], CHUNK, made, schema)

    def _blocker(self) -> Callable:
        def made(rows: list[dict]) -> dict:
            return {
                "ids": _longs(r["id"] for r in rows), "rows": _longs(r["row"] for r in rows),
                "labels": [r["label"] for r in rows], "vectors": b"".join(r["v"] for r in rows),
                "homes": _longs(r["leaf"] for r in rows),
            }

        schema = pa.schema(
            [("ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.list_(pa.string())),
             ("vectors", pa.binary()), ("homes", pa.binary())]
        )
        return lambda batches: _runs(batches, lambda r: 0, ANCHORS, made, schema)

    def search(self, windows: DataFrame, same: bool, most: int, name: str) -> DataFrame:
        """The first `most` rows of each window by score, then id: block, place, slot, id, score, rank.

        `windows` has block, place (of the anchor in its block), slot, low and high (scores, both
        included). `same` asks for rows of the anchor's label, else of other labels; an anchor
        never finds its own row. A first round looks into the leaf of the anchor only; the lowest
        of `most` scores found there raises `low` for the second, which looks into every leaf
        whose range of scores meets the window.
        """
        key = ["block", "place", "slot"]
        near = self.scratch.cut(f"{name}-near", self._round(windows, same, most, home=True))
        floor = near.groupBy(*key).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        raised = windows.join(floor.where(F.col("n") == most).drop("n"), key, "left").withColumn(
            "low", F.greatest("low", F.coalesce("floor", F.lit(_LOW)))
        )
        return self.scratch.cut(f"{name}-found", self._round(raised, same, most, home=False))

    def _round(self, windows: DataFrame, same: bool, most: int, home: bool) -> DataFrame:
        # a block has ANCHORS anchors, each with a few slots
        asked = windows.groupBy("block").agg(F.collect_list(F.struct("place", "slot", "low", "high")).alias("asked"))
        blocks = self.blocks.join(asked, "block")
        pairs = blocks.mapInArrow(self._visits(home), "block bigint, chunk bigint")
        met = pairs.join(blocks.select([F.col(c).alias(f"a_{c}") for c in blocks.columns]), F.col("block") == F.col("a_block"))
        scored = met.join(self.chunks, "chunk").mapInArrow(
            self._scorer(same, most, home), "block bigint, place int, slot int, id bigint, row bigint, score bigint"
        )
        by = Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "id", "row")
        return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).drop("row")

    def _visits(self, home: bool) -> Callable:
        tree, ranges, spans, matrix = self.tree, self.ranges, self.spans, self._reader()

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    if home:
                        place = {a["place"] for a in row["asked"]}
                        homes = np.frombuffer(row["homes"], np.int64)
                        leaves = sorted({int(homes[p]) for p in place})
                    else:
                        x, asked = matrix(row["vectors"]), _asked(row["asked"])
                        square = (x**2).sum(axis=1)
                        leaves = []
                        for leaf, known in ranges.items():
                            lowest, highest = known.scores(square, tree.to_points(x, leaf))
                            at = asked["place"]
                            if ((highest[at] >= asked["low"]) & (lowest[at] <= asked["high"])).any():
                                leaves.append(leaf)
                    for leaf in leaves:
                        for first, count in spans[leaf]:
                            for start in range(0, count, 10_000):
                                chunks = np.arange(first + start, first + min(count, start + 10_000))
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(chunks), row["block"])), pa.array(chunks)], names=["block", "chunk"]
                                )

        return visits

    def _scorer(self, same: bool, most: int, home: bool) -> Callable:
        tree, matrix, exact = self.tree, self._reader(), self.exact

        def found(row: dict) -> list[tuple]:
            a, asked = matrix(row["a_vectors"]), _asked(row["a_asked"])
            leaf = row["leaf"]
            known = Ranges(row["low"], row["high"], row["least"], row["most"])
            lowest, highest = known.scores((a**2).sum(axis=1), tree.to_points(a, leaf))
            at = asked["place"]
            meets = (highest[at] >= asked["low"]) & (lowest[at] <= asked["high"])
            if home:
                meets &= np.frombuffer(row["a_homes"], np.int64)[at] == leaf
            asked = asked[meets]
            places = np.unique(asked["place"])
            if not len(places):
                return []
            scores = products(a[places], matrix(row["vectors"]), exact)
            ids, rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
            own, labels = np.frombuffer(row["a_rows"], np.int64), np.array(row["labels"], object)
            out = []
            for place, score in zip(places, scores, strict=True):
                fits = ((labels == row["a_labels"][place]) == same) & (rows != own[place])
                for window in asked[asked["place"] == place]:
                    took = first_of(score, fits & (score >= window["low"]) & (score <= window["high"]), ids, rows, most)
                    out += [
                        (row["block"], int(place), int(window["slot"]), int(ids[k]), int(rows[k]), int(score[k]))
                        for k in took
                    ]
            return out

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["block", "place", "slot", "id", "row", "score"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            for batch in batches:
                for at in range(batch.num_rows):
                    out = found(batch.slice(at, 1).to_pylist()[0])
                    if out:
                        columns = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        return scored


def products(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; beyond what doubles hold they are taken in whole numbers.

    Products beyond 2^62 either way become that.
    """
    if exact:
        return (a @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    rows = [[sum(p * q for p, q in zip(map(int, row), other, strict=True)) for other in whole] for row in a]
    return np.array([[min(max(v, _LOW), _HIGH) for v in row] for row in rows], np.int64)


def first_of(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` that fit, by score descending, then id, then row."""
    some = np.flatnonzero(fits)
    if len(some) > most:
        least = np.partition(score[some], len(some) - most)[len(some) - most]
        some = some[score[some] >= least]
    return some[np.lexsort((rows[some], ids[some], ~score[some]))][:most]


def _asked(rows: list[dict]) -> np.ndarray:
    kinds = [("place", np.int64), ("slot", np.int64), ("low", np.int64), ("high", np.int64)]
    return np.array([(r["place"], r["slot"], r["low"], r["high"]) for r in rows], kinds)


def _longs(values) -> bytes:
    return np.fromiter(values, np.int64).tobytes()


def _packer(width: int, kind: str) -> Callable:
    """Whole components of the vectors as bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            filled = np.zeros((batch.num_rows, width))
            filled[np.arange(width) < sizes[:, None]] = np.floor(SCALE * values)
            data = filled.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "label", "anchor")), pa.array([v.tobytes() for v in data], pa.binary())],
                names=["row", "id", "label", "anchor", "v"],
            )

    return packed


def _runs(batches, key: Callable, most: int, made: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for every run of `most` rows, or fewer, with one key."""
    held: list[dict] = []
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            for row in batch.slice(start, 2000).to_pylist():
                if held and (len(held) == most or key(row) != key(held[0])):
                    yield pa.RecordBatch.from_pylist([made(held)], schema)
                    held = []
                held.append(row)
    if held:
        yield pa.RecordBatch.from_pylist([made(held)], schema)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    anchors: Column,
    label: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Per anchor and positive, the first negatives whose score is `low` to `high` percent of its.

    Scores are integer inner products of floor(256 * x). The positives of an anchor are the first
    rows of its label by score, then id; negatives are rows of other labels. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Rows without id, label or vector, or with a NULL or non-finite component, take no part.
    Repeated rows count each; an anchor that is repeated is mined each time, and finds its copy
    as a positive. A positive of negative score has an empty window. An empty table, or one
    without anchors, gives no rows. Other columns are not read.
    """
    own = F.col("label") if label is None else label
    prepared = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(common.plain(id_column)).cast("bigint").alias("id"),
        own.cast("string").alias("label"),
        F.col(common.plain(vector_column)).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    index = VectorIndex(spark, prepared)
    if index.tree is None:
        return spark.createDataFrame([], RESULT)
    each = index.blocks.mapInArrow(_places, "block bigint, place int, anchor_id bigint")
    everything = [F.lit(0).alias("slot"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high")]
    nearest = index.search(each.select("block", "place", *everything), True, positives, "positives")
    # floor and ceiling of a percentage, in whole numbers
    hundreds, rest = "(score - pmod(score, 100)) div 100", "pmod(score, 100)"
    below = F.expr(f"{hundreds} * {int(high)} + ({rest} * {int(high)}) div 100")
    above = F.expr(f"{hundreds} * {int(low)} + ({rest} * {int(low)} + 99) div 100")
    asked = index.scratch.cut(
        "windows",
        nearest.join(each, ["block", "place"]).select(
            "block", "place", F.col("rank").alias("slot"), above.alias("low"), below.alias("high"),
            "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        ).where("low <= high"),
    )
    found = index.search(asked.select("block", "place", "slot", "low", "high"), False, negatives, "negatives")
    return found.join(asked, ["block", "place", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every anchor of a block."""
    for batch in batches:
        for at in range(batch.num_rows):
            ids = np.frombuffer(batch.column("ids")[at].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("block")[at].as_py()] * len(ids), pa.int64()),
                 pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)],
                names=["block", "place", "anchor_id"],
            )
