"""Quality rules by compression: text that compresses far too well or hardly at all is rejected.

The zstandard ratio (bytes over compressed bytes) of the whole text and of each chunk of
`CHUNK` bytes is held against a band for its length, as short texts compress less: below the
band text is close to random, above it text repeats itself.

The bands follow the table itself. Distinct texts are dealt by bytes per character (Latin, Cyrillic
and Chinese text differ in ratio) and by length, `PER_OCTAVE` bands to a doubling; neighbours are
pooled until a band has `LEAST` texts. Limits lie `SPREADS` spreads from a band's median ratio; the
spread is 1.4826 times the median distance from the median. Whole chunks are a band of their own.
All texts count, the base counts aside; limits mean what is usual in the table, so text that is most
of a band passes. Scripts with fewer texts than `LEAST` have the wide limits of `BANDS`, and no
limit lies outside those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import WordHashes

#: (up to so many bytes, least ratio, largest ratio). The last band holds for all beyond.
#: Outermost limits, and the only ones of scripts with few texts.
BANDS = (
    (255, 0.0, 3.0),
    (1023, 1.05, 3.0),
    (4095, 1.25, 4.0),
    (16383, 1.36, 5.0),
    (None, 1.42, 7.0),
)
CHUNK = 4096
#: A text is rejected if chunks outside their bands hold more than this share of its bytes.
BAD_SHARE = 0.25
LEVEL = 3
PER_OCTAVE, LEAST, SPREADS = 4, 100, 4.0
#: Least spread, as a share of the median: near copies may fill a band.
LEAST_SPREAD = 0.01
#: Ratios are counted in steps of 1 / `STEPS`, up to `TOP`.
STEPS, TOP = 512, 16
_WHOLE_CHUNK = -1
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8
_FACTOR = 0x9E3779B97F4A7C15

_RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_share double"
)


def quality(
    docs: DataFrame,
    bands=None,
    chunk: int = CHUNK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, counts of the text, base_failed, kept, ratio, bad_share.

    base_failed: under 20 words, or over 30 % of the words lie in 8-word windows found twice
    or more. kept: not base_failed, and the whole text and three quarters of its bytes are
    inside the bands. NULL and empty texts have no words, fail the base and have ratio 0.
    `bands` gives fixed limits in the form of `BANDS`; by default `limits` derives them from all
    texts, in a pass before. Repeated rows get equal verdicts. Other columns are not read.
    """
    bands = limits(docs, chunk, text_column) if bands is None else bands
    common.small_batches(docs.sparkSession)
    texts = docs.select(
        F.col(common.plain(id_column)).alias("doc_id"),
        common.blob(F.col(common.plain(text_column))).alias("body"),
    )
    identity = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        lambda batches: _measured(batches, bands, chunk), f"doc_id {identity}, {_RESULT}"
    )


def keep(docs: DataFrame, bands=None, chunk: int = CHUNK, text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text passes; see `quality`."""
    bands = limits(docs, chunk, text_column) if bands is None else bands
    common.small_batches(docs.sparkSession)
    at = docs.columns.index(text_column)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = WordHashes(), zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            bodies = ((x.as_py() or "").encode() for x in batch.column(at))
            kept = [measure(x, bands, chunk, hashes, packer)[6] for x in bodies]
            yield batch.filter(pa.array(kept, pa.bool_()))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return numbered.mapInArrow(passed, numbered.schema).toDF(*docs.columns)


def limits(docs: DataFrame, chunk: int = CHUNK, text_column: str = "text") -> dict:
    """By bytes per character: (bands of texts, bands of whole chunks), from all distinct texts.

    Only counts of rounded ratios reach the driver: a few thousand a length band at most.
    """
    common.small_batches(docs.sparkSession)
    bodies = docs.select(common.blob(F.col(common.plain(text_column))).alias("body"))
    seen = bodies.mapInArrow(
        lambda batches: _ratios(batches, chunk), "digest long, kind int, place int, step int"
    )
    cells = seen.distinct().groupBy("kind", "place", "step").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict[int, dict[int, int]]] = {}
    for kind, place, step, n in cells.collect():
        counts.setdefault(kind, {}).setdefault(place, {})[step] = n
    found = {}
    for kind, places in counts.items():
        chunks = places.pop(_WHOLE_CHUNK, {})
        enough = sum(chunks.values()) >= LEAST
        found[kind] = (_pooled(places), ((None, *_spread(chunks)),) if enough else None)
    return found


def _ratios(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """A row for each text and whole chunk; digests let equal ones count once."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    names, small = ["digest", "kind", "place", "step"], pa.int32()
    for batch in batches:
        rows = []
        for value in batch.column("body"):
            body = value.as_py()
            if not body:
                continue
            kind = _kind(body)
            whole = range(0, len(body) - chunk + 1, chunk) if len(body) > chunk else ()
            parts = [(body, _place(len(body)))]
            parts += [(body[i : i + chunk], _WHOLE_CHUNK) for i in whole]
            for part, place in parts:
                step = min(round(_ratio(part, packer) * STEPS), TOP * STEPS)
                digest = xxhash.xxh64_intdigest(part) - (1 << 63)
                rows.append((digest, kind, place, step))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        kinds = (pa.int64(), small, small, small)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )


def _kind(body: bytes) -> int:
    """Bytes per character, rounded: 1 for Latin text, 2 for Cyrillic, 3 for Chinese."""
    return round(len(body) / len(body.decode()))


def _place(size: int) -> int:
    """The length band of so many bytes."""
    return math.floor(math.log2(size) * PER_OCTAVE)


def _pooled(places: dict[int, dict[int, int]]) -> tuple:
    """Bands in the form of `BANDS`, each with `LEAST` texts or more."""
    groups, open_, held = [], [], 0
    for place in sorted(places):
        open_.append(place)
        held += sum(places[place].values())
        if held >= LEAST:
            groups.append(open_)
            open_, held = [], 0
    if not groups:
        return BANDS
    groups[-1].extend(open_)
    bands = []
    for group in groups:
        steps: dict[int, int] = {}
        for place in group:
            for step, n in places[place].items():
                steps[step] = steps.get(step, 0) + n
        most = math.ceil(2 ** ((group[-1] + 1) / PER_OCTAVE)) - 1
        bands.append((most, *_spread(steps)))
    return (*bands[:-1], (None, *bands[-1][1:]))


def _spread(steps: dict[int, int]) -> tuple[float, float]:
    values = np.array(sorted(steps))
    counts = np.array([steps[x] for x in values.tolist()])
    centre = _median(values, counts)
    spread = max(1.4826 * _median(np.abs(values - centre), counts), LEAST_SPREAD * centre)
    return float(centre - SPREADS * spread) / STEPS, float(centre + SPREADS * spread) / STEPS


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values)
    upto = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def _measured(batches: Iterator[pa.RecordBatch], bands, chunk: int) -> Iterator[pa.RecordBatch]:
    hashes, packer = WordHashes(), zstandard.ZstdCompressor(level=LEVEL)
    fields = [x.split(" ") for x in _RESULT.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    for batch in batches:
        rows = [measure(x.as_py(), bands, chunk, hashes, packer) for x in batch.column("body")]
        columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)),
            ],
            names=["doc_id", *(name for name, _ in fields)],
        )


def measure(body: bytes, bands, chunk: int, hashes: WordHashes, packer) -> tuple:
    words = body.split()
    n_words = len(words)
    without = body.translate(None, common.SPACES)
    word_chars = len(without.decode())
    n_symbols = len(body) - len(body.translate(None, _SYMBOLS))
    lines = [x for x in body.split(b"\n") if x.translate(None, common.SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(hashes.of(words))
    base_failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    ratio = _ratio(body, packer)
    whole, tables = None, (bands,)
    if isinstance(bands, dict):
        own, whole = bands.get(_kind(body) if body else 1, (BANDS, None))
        tables = (own, BANDS)
    outside = 0
    if len(body) > chunk:
        for x in (body[i : i + chunk] for i in range(0, len(body), chunk)):
            held = (whole, BANDS) if whole and len(x) == chunk else tables
            outside += 0 if _inside(len(x), _ratio(x, packer), held) else len(x)
    bad_share = outside / len(body) if body else 0.0
    kept = not base_failed and _inside(len(body), ratio, tables) and bad_share <= BAD_SHARE
    return (
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, ratio, bad_share
    )


def repeated_words(values: np.ndarray) -> int:
    """Words inside a window of 8 words that the text holds twice or more."""
    if len(values) <= _WINDOW:
        return 0
    windows = common.mixed(common.rolled(values, _WINDOW, _FACTOR))
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(values) + 1, np.int64)
    change[: len(again)] += again
    change[_WINDOW:] -= again
    return int((np.cumsum(change)[:-1] > 0).sum())


def _ratio(body: bytes, packer) -> float:
    return len(body) / len(packer.compress(body)) if body else 0.0


def _inside(size: int, ratio: float, tables) -> bool:
    """The ratio lies in the band of that size in every table."""
    for bands in tables:
        for most, low, high in bands:
            if most is None or size <= most:
                if not low <= ratio <= high:
                    return False
                break
    return True
