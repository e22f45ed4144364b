"""Near-duplicate documents by b-bit MinHash.

Every document is reduced to its set of shingles; documents of one set are one class, which is
linked by one representative, so exact copies cost nothing further. Of `LANES` minima over
the set, groups of `ROWS` make `LANES / ROWS` band keys, and of every minimum `BITS` low bits
stay in a packed signature. Classes that share a band key are candidates; their similarity is
estimated by counting equal lanes of the signatures, corrected for chance collisions, and
confirmed on the full sets.

Pairs within a bucket are not written out. First each member is held against the bucket's most
central member (the one whose other buckets are largest), and links found are contracted to
components. Only members outside the bucket's largest component are then held against members
of other components, once for all the buckets that two of them share, and with a longer
signature besides; pairs inside one component need no test, as their link changes nothing.

A pair of similarity 0.75 meets in no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6. The
margins of the estimates are five of their standard deviations. Links themselves are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch, WordHashes
from covermart.llm.components import components

LANES, ROWS, BITS = 128, 4, 4
BANDS = LANES // ROWS
#: Estimated similarity below the limit at which a pair is still confirmed on its sets.
MARGIN = 0.2
#: The longer signature, made for classes that the first comparison leaves unsettled.
MORE_LANES, MORE_BITS, MORE_MARGIN = 1024, 2, 0.08
_FACTOR = 0x9E3779B97F4A7C15

_SETS = "n_shingles long, d1 long, d2 long, sig array<bigint>, bands array<bigint>"


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    words: int = 5,
    percent: int = 75,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    `component_id` is the smallest doc_id reachable, `kept` marks its row. A text with fewer
    words is one shingle; NULL texts and texts without words have no shingles and no links.
    Rows without doc_id are linked like others, but are never the row that stays; a component
    of such rows alone has no component_id. Links hold between texts: rows that repeat a doc_id
    with another text are each linked by their own. Other columns are not read. An empty table
    gives an empty result.
    """
    scratch = Scratch(spark, "near")
    texts = docs.select(
        F.col(common.plain(id_column)).alias("doc_id"),
        common.blob(F.col(common.plain(text_column))).alias("body"),
    ).withColumn("row", F.xxhash64("doc_id", "body"))  # names a class, with or without an id
    identity = texts.schema["doc_id"].dataType.simpleString()
    signed = scratch.cut(
        "signatures",
        texts.mapInArrow(lambda b: _signatures(b, words), f"row long, doc_id {identity}, {_SETS}"),
    )
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("row").alias("cls"), F.min("doc_id").alias("least")
    )
    classes = scratch.cut("classes", classes)
    leads = signed.drop("doc_id").withColumnRenamed("row", "cls").join(
        classes.select("cls", "d1", "d2"), ["cls", "d1", "d2"], "left_semi"
    )
    leads = scratch.cut("leads", leads.dropDuplicates(["cls", "d1", "d2"]))

    keys = leads.select("cls", F.posexplode("bands").alias("band", "key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.cut("members", keys.join(full, "key"))
    rank = scratch.cut("rank", members.groupBy("cls").agg(F.sum("n").alias("score")))
    packs = scratch.cut(
        "packs", leads.join(rank, "cls", "left_semi").withColumnRenamed("n_shingles", "n")
    )
    sets = scratch.cut(
        "sets",
        texts.drop("doc_id")
        .join(packs.select(F.col("cls").alias("row"), "d1", "d2"), "row")
        .dropDuplicates(["row"])
        .mapInArrow(lambda b: _shingle_sets(b, words), "cls long, shingles array<bigint>"),
    )

    ranked = members.join(rank, "cls")
    centre = ranked.groupBy("key").agg(F.max(F.struct("score", "cls")).alias("top"))
    stars = (
        members.join(centre, "key")
        .select(F.col("top.cls").alias("u"), F.col("cls").alias("v"))
        .where("u != v")
        .distinct()
    )
    short = packs.select("cls", "n", "sig")
    likely = stars.join(_side(short, "u"), "u").join(_side(short, "v"), "v").where(
        _sizes(percent) & _alike("sig", LANES, BITS, percent / 100 - MARGIN)
    )
    links = _confirmed(scratch, "stars", likely.select("u", "v", "n_u", "n_v"), sets, percent)
    labels = components(scratch, links, "round1")

    placed = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "band", "cls", F.coalesce("label", "cls").alias("label")
    )
    placed = scratch.cut("placed", placed)
    parts = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = (
        parts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "label")).alias("top"))
        .where("parts > 1")
        .select("key", F.col("top.label").alias("main"))
    )
    unsettled = scratch.cut("unsettled", placed.join(open_, "key"))
    long = sets.join(unsettled.select("cls").distinct(), "cls", "left_semi").mapInArrow(
        _more_lanes, "cls long, more array<bigint>"
    )
    wide = scratch.cut(
        "wide", packs.select("cls", "n", "sig", "bands").join(long, "cls").dropDuplicates(["cls"])
    )
    outside = unsettled.where("label != main").withColumnsRenamed({"cls": "u", "label": "label_u"})
    others = unsettled.select("key", F.col("cls").alias("v"), F.col("label").alias("label_v"))
    first_shared = F.coalesce(
        *(F.when(F.col("bands_u")[i] == F.col("bands_v")[i], F.lit(i)) for i in range(BANDS))
    )
    rest = (
        outside.join(_side(wide, "u"), "u")
        .join(others.join(_side(wide, "v"), "v"), "key")
        .where(
            F.expr("label_u != label_v AND (label_v = main OR u < v)")
            & _sizes(percent)
            & _alike("sig", LANES, BITS, percent / 100 - MARGIN)
            & _alike("more", MORE_LANES, MORE_BITS, percent / 100 - MORE_MARGIN)
            & (first_shared == F.col("band"))
        )
        .select("u", "v", "n_u", "n_v")
    )
    more = _confirmed(scratch, "rest", rest, sets, percent)
    labels = components(scratch, links.unionByName(more), "round2")

    placed = scratch.cut(
        "labelled", classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    )
    best = scratch.cut("best", placed.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("best")))
    reached = scratch.cut(
        "reached",
        placed.join(best, "label", "left").select(
            "d1", "d2", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("best")).alias("component_id")
        ),
    )
    rows = signed.select("doc_id", "n_shingles", "d1", "d2")
    return (
        rows.join(reached, ["d1", "d2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") == 0, F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _side(frame: DataFrame, name: str) -> DataFrame:
    """The columns of one side of a pair."""
    renamed = {c: f"{c}_{name}" for c in frame.columns if c != "cls"}
    return frame.withColumnsRenamed({"cls": name, **renamed})


def _sizes(percent: int) -> Column:
    """The sizes of two sets allow the similarity."""
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


def _alike(name: str, lanes: int, bits: int, least: float) -> Column:
    """Equal lanes of two packed signatures, less those by chance, suggest the similarity."""
    chance = 1 / 2**bits
    most_unequal = lanes - int((chance + max(least, 0.0) * (1 - chance)) * lanes)
    marks = sum(1 << at for at in range(0, 63, bits))
    unequal = F.lit(0)
    for i in range(lanes * bits // 64):
        differ = F.col(f"{name}_u")[i].bitwiseXOR(F.col(f"{name}_v")[i])
        lane = differ
        for bit in range(1, bits):
            lane = lane.bitwiseOR(F.shiftrightunsigned(differ, bit))
        unequal = unequal + F.bit_count(lane.bitwiseAND(F.lit(marks)))
    return unequal <= most_unequal


def _confirmed(
    scratch: Scratch, name: str, pairs: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    pairs = scratch.cut(f"{name}-likely", pairs)
    first = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("a"))
    second = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    linked = pairs.join(first, "u").join(second, "v").where(
        shared * 100 >= (F.col("n_u") + F.col("n_v") - shared) * percent
    )
    return scratch.cut(f"{name}-links", linked.select("u", "v").distinct())


def _shingles(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.of(words)
    return np.unique(common.mixed(common.rolled(values, min(size, len(words)), _FACTOR) + np.uint64(min(size, len(words)))))


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in common.slices(batches, "body", 1_500_000):
        sets = [_shingles(x.as_py().lower().split(), hashes, words) for x in batch.column("body")]
        sizes = np.array([len(x) for x in sets], np.int64)
        digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
        pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        minima = _minima([x for x in sets if len(x)], LANES)
        bands = np.zeros((len(sets), BANDS), np.int64)
        packed = np.zeros((len(sets), LANES * BITS // 64), np.int64)
        bands[sizes > 0], packed[sizes > 0] = _bands(minima), _packed(minima, BITS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                pa.array(sizes),
                pa.array(pairs[:, 0]),
                pa.array(pairs[:, 1]),
                _arrays(packed),
                _arrays(bands),
            ],
            names=["row", "doc_id", "n_shingles", "d1", "d2", "sig", "bands"],
        )


def _arrays(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _minima(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """Smallest value of each lane's linear hash over each set."""
    draw = np.random.default_rng(lanes)
    factors = (draw.integers(0, 2**31, lanes, np.uint32) << np.uint32(1)) | np.uint32(1)
    shifts = draw.integers(0, 2**32, lanes, np.uint32)
    out = np.empty((len(sets), lanes), np.uint32)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (held < 30_000 or last == first):
            held += len(sets[last])
            last += 1
        flat = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        lengths = np.array([len(x) for x in sets[first:last]])
        starts = np.cumsum(lengths) - lengths
        value = np.empty_like(flat)
        for lane in range(lanes):
            np.multiply(flat, factors[lane], out=value)
            np.add(value, shifts[lane], out=value)
            out[first:last, lane] = np.minimum.reduceat(value, starts)
        first = last
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    parts = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(minima), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        key = common.mixed(key * np.uint64(_FACTOR) + parts[:, :, row])
    return common.signed(key)


def _packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of all lanes, `64 / bits` lanes to a long."""
    per = 64 // bits
    low = (minima & np.uint32(2**bits - 1)).astype(np.uint64).reshape(len(minima), minima.shape[1] // per, per)
    shift = np.arange(per, dtype=np.uint64) * np.uint64(bits)
    return common.signed(np.bitwise_or.reduce(low << shift, axis=2))


def _more_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longer signature, from the sets."""
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            sets = [np.asarray(x.values).view(np.uint64) for x in part.column("shingles")]
            packed = _packed(_minima(sets, MORE_LANES), MORE_BITS)
            yield pa.RecordBatch.from_arrays(
                [part.column("cls"), _arrays(packed)], names=["cls", "more"]
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in common.slices(batches, "body", 1_500_000):
        names, sets = [], []
        for body, cls, d1, d2 in zip(
            batch.column("body"),
            batch.column("row").to_pylist(),
            batch.column("d1").to_pylist(),
            batch.column("d2").to_pylist(),
            strict=True,
        ):
            found = _shingles(body.as_py().lower().split(), hashes, words)
            if xxhash.xxh3_128_digest(found.tobytes()) == np.array([d1, d2]).tobytes():
                names.append(cls)
                sets.append(found)
        if not sets:
            continue
        offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(common.signed(np.concatenate(sets)))
                ),
            ],
            names=["cls", "shingles"],
        )
