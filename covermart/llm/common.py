"""Helpers that the operators share: written tables, word hashes, batches of whole texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.session import shared_folder

#: Everything between these characters is a word.
SPACES = b" \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_U64 = np.uint64


#: Largest Arrow batch between Spark and its Python workers. Spark's default of 64 MB makes
#: a task hold several hundred MB when whole texts travel.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of `BATCH_BYTES`, unless it is smaller."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_in_bytes(spark.conf.get(key, "64m")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it: a whole number, with a unit or in bytes."""
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([kmgtp]?)(?:i?b)?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


class Scratch:
    """Tables of one run, in a folder of its own under the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, name: str, frame: DataFrame) -> DataFrame:
        """The frame, computed once and read from files that every executor reaches."""
        path = f"{self.folder}/{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)


def blob(text: str | Column) -> Column:
    """UTF-8 bytes of a text, NULL as none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


class WordHashes(dict):
    """64-bit hash by word. Emptied when full, so its size is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a public hash)."""
    values = (values ^ (values >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> _U64(33))


def rolled(values: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Polynomial hash of every run of `size` values, one for each start."""
    if len(values) < size:
        return np.empty(0, _U64)
    total, have = values, 1
    while have * 2 <= size:
        shift = _U64(pow(factor, have, 1 << 64))
        total = total[: len(total) - have] * shift + total[have:]
        have *= 2
    while have < size:
        total = total[: len(values) - have] * _U64(factor) + values[have:]
        have += 1
    return total


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts hold about `most` bytes, one row at least."""
    for batch in batches:
        sizes = np.diff(
            np.frombuffer(
                batch.column(column).cast(pa.large_binary()).buffers()[1],
                np.int64,
                batch.num_rows + 1,
                batch.column(column).cast(pa.large_binary()).offset * 8,
            )
        )
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def plain(name: str) -> str:
    """A column name as Spark reads it literally."""
    return f"`{name.replace('`', '``')}`"
