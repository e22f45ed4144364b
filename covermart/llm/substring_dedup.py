"""Removal of long passages that occur more than once.

Suffix trees over prefix groups. A tree over every suffix of the corpus has no memory large
enough, so suffixes are split by a prefix and each group gets subtrees of its own:

1. Of each window of `size` words the run of `GRAM` words with the smallest hash is the place
   where its suffix is entered (equal windows choose the same place). Windows that share a
   place form a context, and its run of words is the prefix of its group. Only groups with two
   entries go on, and equal contexts are one leaf with a multiplicity, summed before and after
   the shuffle, so thousands of copies weigh as much as one.
2. Groups are packed into tasks. A task reads them in order and builds the levels of their
   subtrees (depth 1, 2, 4, ... `size` words) by naming, level by level, the pairs of nodes
   that follow each other. A node at depth `size` with two leaves is a repeat; the maximal
   repeats are the runs of such nodes along a text.
3. A group with more than `GROUP` contexts gets a longer prefix: the whole window, whose
   node at full depth is its group.

Contexts carry 128 bits of their words, trees compare 64 bits a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch, WordHashes

#: Words of the first prefix, the one that names a group.
GRAM = 8
#: Contexts in a group beyond which its prefix grows to the whole window.
GROUP = 2000
#: Words that a task turns into arrays at a time.
SLAB = 150_000
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

_ANCHOR = "grp long, c1 long, c2 long, row long, pos long"
_CONTEXT = "grp long, c1 long, c2 long, windows int, words binary"
_FOUND = "grp long, c1 long, c2 long, mask long"
_WINDOW = "w1 long, w2 long, grp long, c1 long, c2 long, at int"


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    size: int = 35,
    group: int = GROUP,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of `size` words that covers it starts anywhere else too, in the
    same document or another; windows are those of the input. `kept_text` holds the other
    words joined by one space. A NULL text has no words; a text shorter than a window keeps
    all of them. Repeated rows count as documents of their own, and all of them lose the
    passage. Other columns of the input are not read. The result of an empty table is empty.
    """
    if not GRAM < size <= GRAM + 40:
        raise ValueError(f"size must be {GRAM + 1} to {GRAM + 40} words")
    scratch = Scratch(spark, "repeats")
    texts = docs.select(
        F.col(common.plain(id_column)).alias("doc_id"),
        common.blob(F.col(common.plain(text_column))).alias("body"),
    ).withColumn("row", F.xxhash64("doc_id", "body", F.lit(size)))

    anchors = scratch.cut("anchors", _map(texts.select("row", "body"), _anchors, _ANCHOR, size))
    again = anchors.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    again = scratch.cut("again", again)  # so that the join can split the rows of a hot group
    places = scratch.cut("places", anchors.join(again, "grp", "left_semi"))

    contexts = scratch.cut(
        "contexts",
        places.groupBy("grp", "c1", "c2").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos")).alias("first")
        ),
    )
    groups = scratch.cut(
        "groups",
        contexts.groupBy("grp").agg(F.count(F.lit(1)).alias("n_contexts")).where("n_contexts > 1"),
    )
    wanted = (
        contexts.join(groups, "grp", "left_semi")
        .groupBy(F.col("first.row").alias("row"))
        .agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "grp", "c1", "c2")).alias("at"))
    )
    leaves = scratch.cut(
        "leaves", _map(texts.join(wanted, "row").select("body", "at"), _leaves, _CONTEXT, size)
    )
    sized = leaves.join(groups, "grp")
    small = sized.where(F.col("n_contexts") <= group).select(*leaves.columns)
    found = _map(
        small.repartition("grp").sortWithinPartitions("grp", "c1", "c2"), _subtrees, _FOUND, size
    )
    large = sized.where(F.col("n_contexts") > group).dropDuplicates(["grp", "c1", "c2"])
    windows = scratch.cut("windows", _map(large.select(*leaves.columns), _windows, _WINDOW, size))
    deep = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found_deep = (
        windows.join(deep.select("w1", "w2"), ["w1", "w2"], "left_semi")
        .groupBy("grp", "c1", "c2")
        .agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))
    )
    copies = contexts.where("n > 1").select("grp", "c1", "c2", F.lit(-1).cast("long").alias("mask"))
    masks = scratch.cut(
        "masks",
        found.unionByName(found_deep)
        .unionByName(copies)
        .groupBy("grp", "c1", "c2")
        .agg(F.expr("bit_or(mask)").alias("mask")),
    )
    spans = (
        places.join(masks, ["grp", "c1", "c2"])
        .groupBy("row")
        .agg(F.collect_set(F.struct("pos", "mask")).alias("spans"))
    )
    spans = scratch.cut("spans", spans)
    identity = docs.select(F.col(common.plain(id_column)).alias("doc_id")).schema[0].dataType
    result = f"doc_id {identity.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return _map(
        texts.join(spans, "row", "left").select("doc_id", "body", "spans"), _kept, result, size
    )


def _map(frame: DataFrame, function, schema: str, size: int) -> DataFrame:
    return frame.mapInArrow(lambda batches: function(batches, size), schema)


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for rows, lists in _slabs(batches):
        words = [hashes.of(x) for x in lists]
        lengths = np.array([len(x) for x in words])
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        if len(flat) >= size:
            yield _slab_anchors(np.array(rows, np.int64), lengths, flat, size)


def _slabs(batches):
    """Rows and their words, in slabs of bounded size; a single long text may exceed it."""
    rows, lists, held = [], [], 0
    for batch in batches:
        for row, body in zip(batch.column("row").to_pylist(), batch.column("body"), strict=True):
            words = body.as_py().split()
            rows.append(row)
            lists.append(words)
            held += len(words)
            if held >= SLAB:
                yield rows, lists
                rows, lists, held = [], [], 0
    if rows:
        yield rows, lists


def _slab_anchors(rows, lengths, flat, size) -> pa.RecordBatch:
    document = np.repeat(np.arange(len(rows)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    low = common.mixed(common.rolled(flat, GRAM, _FACTORS[0]))
    grams = low
    place = np.arange(len(low), dtype=np.int32)
    wide, have = size - GRAM + 1, 1
    while have < wide:  # leftmost smallest run of each window
        step = min(have, wide - have)
        left, right = low[:-step], low[step:]
        chosen = left <= right
        low = np.where(chosen, left, right)
        place = np.where(chosen, place[:-step], place[step:])
        have += step
    start = np.flatnonzero(document[: len(flat) - size + 1] == document[size - 1 :])
    if not len(start):
        return _batch(_ANCHOR, [np.empty(0, np.int64)] * 5)
    place = place[start]
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[head, len(start)])
    begin, place = start[head], place[head]
    owner = document[begin]
    within = begin - first[begin]
    pos = (within.astype(np.int64) << 12) | ((place - begin) << 6) | count
    c1, c2 = (_runs(flat, begin, count + size - 1, factor) for factor in _FACTORS)
    return _batch(
        _ANCHOR, [common.signed(grams[place]), common.signed(c1), common.signed(c2), rows[owner], pos]
    )


def _runs(flat, begin, length, factor) -> np.ndarray:
    """Hash of each run of words that starts at `begin`, whatever its place."""
    inverse = pow(factor, -1, 1 << 64)
    steps = np.full(len(flat) + 1, factor, np.uint64)
    steps[0] = 1
    back = np.full(len(flat) + 1, inverse, np.uint64)
    back[0] = 1
    steps, back = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    total = np.r_[np.uint64(0), np.cumsum(common.mixed(flat + np.uint64(factor)) * steps[:-1])]
    value = (total[begin + length] - total[begin]) * back[begin]
    return common.mixed(value + length.astype(np.uint64) * np.uint64(_FACTORS[1]))


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(k)) for c, (_, k) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )


def _leaves(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The words of the contexts that are asked for."""
    hashes = WordHashes()
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for body, wanted in zip(batch.column("body"), batch.column("at"), strict=True):
            words = hashes.of(body.as_py().split())
            for x in wanted.as_py():
                begin, count = x["pos"] >> 12, x["pos"] & 63
                part = words[begin : begin + count + size - 1]
                out.append((x["grp"], x["c1"], x["c2"], count, part.tobytes()))
                held += len(part)
            if held > SLAB:
                yield _batch(_CONTEXT, list(zip(*out, strict=True)))
                out, held = [], 0
        if out:
            yield _batch(_CONTEXT, list(zip(*out, strict=True)))


def _subtrees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each context, from the subtrees of its group."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        left.append(batch)
        table = pa.Table.from_batches(left).combine_chunks()
        groups = table.column("grp").to_numpy()
        end = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
        if end:
            yield _repeated(table.slice(0, end), size)
        left = table.slice(end).to_batches()
    if left:
        yield _repeated(pa.Table.from_batches(left), size)


def _flat_words(table: pa.Table):
    blobs = table.column("words").to_pylist()
    lengths = np.array([len(x) // 8 for x in blobs])
    return np.frombuffer(b"".join(blobs), np.uint64), np.cumsum(lengths) - lengths


def _repeated(table: pa.Table, size: int) -> pa.RecordBatch:
    counts = table.column("windows").to_numpy()
    flat, offsets = _flat_words(table)
    context = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[context] + at
    key = np.column_stack([table.column(x).to_numpy() for x in ("grp", "c1", "c2")])
    _, group = np.unique(key[:, 0], return_inverse=True)
    new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
    distinct = np.cumsum(new) - 1  # a context that came twice is one leaf
    _, level = np.unique(flat, return_inverse=True)
    have = 1
    while have < size:
        step = min(have, size - have)
        pair = level[:-step] * np.int64(level.max() + 1) + level[step:]
        _, level = np.unique(pair, return_inverse=True)
        have += step
    node = group[context] * np.int64(level.max() + 1) + level[start]
    _, leaf = np.unique(distinct[context] * 64 + at, return_index=True)
    nodes, leaves = np.unique(node[leaf], return_counts=True)
    hit = leaves[np.searchsorted(nodes, node)] > 1
    mask = np.zeros(len(counts), np.int64)
    np.bitwise_or.at(mask, context[hit], np.int64(1) << at[hit].astype(np.int64))
    some = np.flatnonzero(mask)
    return _batch(_FOUND, [key[some, 0], key[some, 1], key[some, 2], mask[some]])


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each window of the contexts by the hash of all its words."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        counts = table.column("windows").to_numpy()
        flat, offsets = _flat_words(table)
        context = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = offsets[context] + at
        w1, w2 = (common.mixed(common.rolled(flat, size, x))[start] for x in _FACTORS)
        names = [table.column(x).to_numpy()[context] for x in ("grp", "c1", "c2")]
        yield _batch(_WINDOW, [common.signed(w1), common.signed(w2), *names, at.astype(np.int32)])


def _kept(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "body", 4_000_000):
        out = []
        for body, spans in zip(batch.column("body"), batch.column("spans"), strict=True):
            words = body.as_py().split()
            n_words = len(words)
            if spans.is_valid:
                change = np.zeros(n_words + 1, np.int64)
                for x in spans.as_py():
                    begin, count = x["pos"] >> 12, x["pos"] & 63
                    for at in range(count):
                        if x["mask"] >> at & 1:
                            change[begin + at] += 1
                            change[begin + at + size] -= 1
                covered = np.cumsum(change)[:-1] > 0
                words = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
            kept = b" ".join(words)
            out.append((n_words, n_words - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        n_words, n_removed, digest, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array(kept, pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )
