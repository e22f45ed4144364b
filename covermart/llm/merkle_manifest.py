"""Merkle manifest of a table, kept as an append log in postorder.

Every row is a leaf. Leaves of one tree (one source) stand in ascending order; aligned builders
take `BLOCK` leaves each and append every node when it is complete: a leaf as it comes, an inner
node right after the last node of its run of `FAN`. Where a node stands in the log of its block
follows from the sizes of the subtrees before it (`position`), so that a proof reads its siblings
by address, without a search. The tops of the blocks are the leaves of the next tier, up to one
subroot a tree; the subroots are the leaves of the last tree, whose top is the root.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch

#: Nodes of a run, and the levels that one builder makes.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: Bytes of a digest.
SIZE = 32


def field(value: Column) -> Column:
    """A value as the leaf hashes it: `-` for NULL, else its UTF-8 length, a colon, the value."""
    text = value.cast("string")
    length = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(length, F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def joined(digests: bytes) -> bytes:
    """Raw digest of a run, whose raw digests are hashed as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


@functools.lru_cache(1 << 17)
def position(level: int, index: int, leaves: int, levels: int) -> int:
    """Place in the log of node `index` of a level, in a tree of so many leaves and levels.

    The node is complete with leaf number `end`. Before it stand all nodes that lie below this
    level and are complete by then, and those of this level and above that were so a leaf earlier.
    """
    end = min((index + 1) * FAN**level, leaves)
    below = sum(-(-end // FAN**k) for k in range(level))
    return below + sum((end - 1) // FAN**k for k in range(level, levels + 1))


def appended(leaves: list[bytes], levels: int) -> bytes:
    """The log of a tree: raw digests in the order in which nodes are complete."""
    log, runs = [], [[] for _ in range(levels + 1)]

    def complete(level: int) -> None:
        node = joined(b"".join(runs[level]))
        runs[level].clear()
        log.append(node)
        runs[level + 1].append(node)

    for digest in leaves:
        log.append(digest)
        runs[0].append(digest)
        for level in range(levels):
            if len(runs[level]) < FAN:
                break
            complete(level)
    for level in range(levels):
        if runs[level]:
            complete(level)
    return b"".join(log)


class Log:
    """Reads runs of a log by address."""

    def __init__(self, log: bytes, leaves: int, whole: int):
        self.log, self.leaves = log, leaves
        self.levels = LEVELS if whole > BLOCK else height(whole)
        self.known: dict[tuple[int, int], bytes] = {}

    def node(self, level: int, index: int) -> bytes:
        at = SIZE * position(level, index, self.leaves, self.levels)
        return self.log[at : at + SIZE]

    def run(self, level: int, run: int) -> bytes:
        """Raw digests of one run of a level, in order."""
        if (level, run) not in self.known:
            width = -(-self.leaves // FAN**level)
            ends = range(run * FAN, min((run + 1) * FAN, width))
            self.known[level, run] = b"".join(self.node(level, k) for k in ends)
        return self.known[level, run]

    def path(self, place: int) -> list[tuple[int, bytes]]:
        """Per level, from the leaf up: its place in its run, and the run."""
        steps = []
        for level in range(self.levels):
            run, own = divmod(place // FAN**level, FAN)
            steps.append((own, self.run(level, run)))
        return steps


_STEPS = pa.list_(pa.struct([("own", pa.int32()), ("run", pa.binary())]))
_STEPS_SQL = "array<struct<own: int, run: binary>>"
_PATHS_SQL = f"tree string, block bigint, subroot string, steps {_STEPS_SQL}"


class Manifest:
    """The log of a table, its subroots and root, and proofs of its rows.

    `rows` holds `id`, `tree` (any string, NULL first), `leaf` and `found` (hex digests; `found`
    is the leaf as it is computed from what is to be checked). Leaves of a tree ascend by id
    (NULL ids first; equal ids by leaf, so repeated rows stand side by side). An empty table has
    an empty log and no root; its proofs are no rows.

    Leaves are numbered along ranges of (tree, id), so a tree with a third of all rows is spread
    over many tasks; a task holds one block at a time. No text is shuffled, only digests.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame):
        self.scratch = Scratch(spark, "manifest")
        # a NULL tree sorts before all others, the empty string included
        key = F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit(""))
        self.id_type = rows.schema["id"].dataType.simpleString()
        leaves = self.scratch.cut("leaves", rows.withColumn("tree", key))
        self.tiers = self._tiers("rows", self._numbered("rows", leaves, ["id", "leaf"]), "id")
        self.subroots = self._tops(self.tiers)
        roots = self.subroots.select(
            F.lit("").alias("tree"), F.col("tree").alias("id"),
            F.col("top").alias("leaf"), F.col("top").alias("found"),
        )
        self.root_tiers = self._tiers("roots", self._numbered("roots", roots, ["id"]), "id")
        root = self._tops(self.root_tiers).first()  # one row at most
        self.root = root["top"] if root else None

    @property
    def log(self) -> DataFrame:
        """tree (`=` and the source; empty for none), tier, block, leaves of the tree's tier, log.

        Tier 1 holds the blocks of rows, each next one those of the tops below it.
        """
        tables = [t.select("tree", F.lit(k).alias("tier"), "block", "n", "log") for k, t in enumerate(self.tiers, 1)]
        return functools.reduce(DataFrame.unionByName, tables)

    def _numbered(self, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """With `place`, the rank within the tree, and `n`, the leaves of the tree."""
        along = self.scratch.cut(
            f"{name}-ordered",
            rows.repartitionByRange("tree", *order)
            .sortWithinPartitions("tree", *order)
            .withColumn("at", F.monotonically_increasing_id()),
        ).withColumn("part", F.shiftright("at", 33))
        # one row for each tree of each range: as many as ranges and trees together
        runs = along.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
        tree = Window.partitionBy("tree")
        earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select(
            "tree", "part", "first",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
            F.sum("rows").over(tree).alias("n"),
        )
        place = F.col("before") + F.col("at") - F.col("first")
        return along.join(runs, ["tree", "part"]).select("tree", "id", "leaf", "found", "n", place.alias("place"))

    def _tiers(self, name: str, leaves: DataFrame, id_column: str) -> list[DataFrame]:
        """The blocks of every tier, the lowest first."""
        id_type = leaves.schema[id_column].dataType.simpleString()
        blocks = leaves.groupBy("tree", F.shiftright("place", 4 * LEVELS).alias("block"), "n").agg(
            F.collect_list(F.struct("place", "leaf", "found", "id")).alias("rows")
        )
        schema = f"tree string, block bigint, n bigint, top string, log binary, found binary, ids array<{id_type}>"
        tiers = [self.scratch.cut(f"{name}-tier-1", blocks.mapInArrow(_built, schema))]
        most = tiers[0].agg(F.max("n")).first()[0] or 0
        while most > BLOCK:
            below = tiers[-1].where(F.col("n") > BLOCK)
            tops = below.select(
                "tree", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"), F.col("block").alias("place"),
                F.col("top").alias("leaf"), F.col("top").alias("found"), F.col("block").alias("id"),
            )
            blocks = tops.groupBy("tree", F.shiftright("place", 4 * LEVELS).alias("block"), "n").agg(
                F.collect_list(F.struct("place", "leaf", "found", "id")).alias("rows")
            )
            made = blocks.mapInArrow(_built, schema.replace(f"array<{id_type}>", "array<bigint>"))
            tiers.append(self.scratch.cut(f"{name}-tier-{len(tiers) + 1}", made))
            most = -(-most // BLOCK)
        return tiers

    def _tops(self, tiers: list[DataFrame]) -> DataFrame:
        """tree, top: the one node that is left of every tree."""
        tops = [t.where(F.col("n") <= BLOCK).select("tree", "top") for t in tiers]
        return functools.reduce(DataFrame.unionByName, tops)

    def _paths(self, tiers: list[DataFrame], above: DataFrame) -> DataFrame:
        """tree, block, subroot, and the steps above the block of the lowest tier.

        `above` holds subroot and the steps above it by tree; only one block of a tree meets it.
        """
        paths = None
        for tier in reversed(tiers):
            held = tier.where(F.col("n") <= BLOCK).join(above, "tree").select("tree", "block", "subroot", "steps")
            if paths is not None:
                children = upper.join(paths, ["tree", "block"]).mapInArrow(_children, _PATHS_SQL)
                held = held.unionByName(children)
            paths, upper = held, tier
        return paths

    def proofs(self) -> DataFrame:
        """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

        `proof_sha256` is the digest of all siblings from the leaf to the root, left to right
        within a level; `folded_root` folds `found` with them; `verified` is whether that is root.
        """
        top = F.lit(None).cast("string").alias("subroot"), F.lit([]).cast(_STEPS_SQL).alias("steps")
        outer = self._paths(self.root_tiers, self._tops(self.root_tiers).select("tree", *top))
        steps = self.root_tiers[0].join(outer, ["tree", "block"]).mapInArrow(_subroots, _PATHS_SQL)
        paths = self._paths(self.tiers, self.scratch.cut("subroot-paths", steps.drop("block")))
        held = self.tiers[0].join(paths, ["tree", "block"]).withColumn("root", F.lit(self.root))
        return held.mapInArrow(
            _proven,
            f"id {self.id_type}, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean",
        )


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One log a block."""
    for batch in batches:
        for at in range(batch.num_rows):
            rows = batch.column("rows").slice(at, 1).flatten()
            rows = rows.take(pc.sort_indices(rows.field("place")))
            n = batch.column("n")[at].as_py()
            leaves = [bytes.fromhex(x) for x in rows.field("leaf").to_pylist()]
            log = appended(leaves, LEVELS if n > BLOCK else height(n))
            found = b"".join(map(bytes.fromhex, rows.field("found").to_pylist()))
            ids = rows.field("id")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tree").slice(at, 1),
                    batch.column("block").slice(at, 1),
                    batch.column("n").slice(at, 1),
                    pa.array([log[-SIZE:].hex()]),
                    pa.array([log], pa.binary()),
                    pa.array([found], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                ],
                names=["tree", "block", "n", "top", "log", "found", "ids"],
            )


def _children(batches: Iterator[pa.RecordBatch], of_root: bool = False) -> Iterator[pa.RecordBatch]:
    """The steps above every leaf of a block, a few hundred leaves at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            tree, block, n, subroot = (batch.column(c)[at].as_py() for c in ("tree", "block", "n", "subroot"))
            count = min(BLOCK, n - block * BLOCK)
            log = Log(batch.column("log")[at].as_py(), count, n)
            above = batch.column("steps")[at].as_py()
            ids = batch.column("ids").slice(at, 1).flatten()
            for start in range(0, count, 256):
                places = range(start, min(count, start + 256))
                steps = [[*({"own": own, "run": run} for own, run in log.path(k)), *above] for k in places]
                if of_root:  # each leaf is the subroot of the tree that its id names
                    trees, blocks = ids.slice(start, len(places)), [0] * len(places)
                    subroots = [log.node(0, k).hex() for k in places]
                else:
                    trees, blocks = pa.array([tree] * len(places), pa.string()), [block * BLOCK + k for k in places]
                    subroots = [subroot] * len(places)
                yield pa.RecordBatch.from_arrays(
                    [trees, pa.array(blocks, pa.int64()), pa.array(subroots, pa.string()), pa.array(steps, _STEPS)],
                    names=["tree", "block", "subroot", "steps"],
                )


def _subroots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The steps above every subroot."""
    return _children(batches, of_root=True)


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            found, root = batch.column("found")[at].as_py(), batch.column("root")[at].as_py()
            count = len(found) // SIZE
            log = Log(batch.column("log")[at].as_py(), count, batch.column("n")[at].as_py())
            above = [(s["own"], s["run"]) for s in batch.column("steps")[at].as_py()]
            outer = [_sides(own, run) for own, run in above]
            tail = b"".join(left + right for left, right in outer)
            leaves, proofs, folded = [], [], []
            for place in range(count):
                sides = [_sides(own, run) for own, run in log.path(place)]
                proof = hashlib.sha256(b"".join(left + right for left, right in sides))
                proof.update(tail)
                value = found[place * SIZE : (place + 1) * SIZE].hex().encode()
                for left, right in sides + outer:
                    value = hashlib.sha256(left + value + right).hexdigest().encode()
                leaves.append(log.node(0, place).hex())
                proofs.append(proof.hexdigest())
                folded.append(value.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids").slice(at, 1).flatten(),
                    pa.array(leaves, pa.string()),
                    pa.array([batch.column("subroot")[at].as_py()] * count, pa.string()),
                    pa.array([root] * count, pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array(folded, pa.string()),
                    pa.array([x == root for x in folded], pa.bool_()),
                ],
                names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def _sides(own: int, run: bytes) -> tuple[bytes, bytes]:
    """Hex text of the siblings before and after a node in its run."""
    text = run.hex().encode()
    return text[: own * 2 * SIZE], text[(own + 1) * 2 * SIZE :]


#: Columns of a document, in the order in which a leaf hashes them.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(spark: SparkSession, docs: DataFrame, found: Column | None = None) -> Manifest:
    """Manifest of documents, one tree a source.

    `found` is the text that is checked against the manifest, by default the text itself; the
    other columns are taken as they are. NULLs hash as `-`, which no value does. Other columns
    are not read.
    """
    common.small_batches(spark)
    own = {c: F.col(common.plain(c)) for c in COLUMNS}
    other = own | {"text": own["text"] if found is None else found}
    return Manifest(
        spark,
        docs.select(
            own["doc_id"].alias("id"),
            own["source"].alias("tree"),
            leaf(*own.values()).alias("leaf"),
            leaf(*other.values()).alias("found"),
        ),
    )


def manifest_sql(tree_levels: int = 6, root_levels: int = 3) -> str:
    """SQL for the proofs of `documents` whose A-Z are lower-cased where 5 divides the id's CRC.

    Trees up to 16 ** `tree_levels` rows and 16 ** `root_levels` sources; a level above the top
    of a tree passes its one node on.
    """
    step = "SELECT i, xor(v >> 1, (v & 1) * 3988292384) AS v FROM ({})"
    table = functools.reduce(lambda inner, _: step.format(inner), range(8), "SELECT range AS i, range AS v FROM range(256)")
    value = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
    fields = [value.format(c) for c in COLUMNS[:-1]]
    leaf_of = lambda text: "sha256(" + " || ".join([*fields, value.format(text)]) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM ({table}))",
        "marked AS (SELECT d.*, coalesce('=' || source, '') AS tree, xor(list_reduce(list_prepend(4294967295, "
        "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 AS chosen FROM documents d, crc)",
        f"leaves AS (SELECT tree, doc_id, {leaf_of('text')} AS h, {leaf_of(f'CASE WHEN chosen THEN {lowered} ELSE text END')} AS f FROM marked)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves)",
        "t0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM placed)",
        "folded0 AS (SELECT tree, doc_id, h AS leaf, i, f, '' AS proof FROM placed)",
    ]

    def level(name: str, k: int) -> list[str]:
        return [
            f"{name}r{k} AS (SELECT tree, i // {FAN} AS r, n, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY ALL)",
            f"{name}{k + 1} AS (SELECT tree, r AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, "
            f"count(*) OVER (PARTITION BY tree) AS n FROM {name}r{k})",
        ]

    def fold(name: str, k: int, at: int) -> str:
        left = f"array_to_string(run[1:i % {FAN}], '')"
        right = f"array_to_string(run[i % {FAN} + 2:], '')"
        keep = "tree, doc_id, leaf" + (", subroot, source_tree" if name == "s" else "")
        return (
            f"folded{at + 1} AS (SELECT {keep}, r AS i, CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, "
            f"CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof "
            f"FROM folded{at} JOIN {name}r{k} USING (tree) WHERE r = i // {FAN})"
        )

    at = 0
    for k in range(tree_levels):
        parts += [*level("t", k), fold("t", k, at)]
        at += 1
    parts += [
        f"s0 AS (SELECT '' AS tree, tree AS source_tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS n FROM t{tree_levels})",
        f"folded{at + 1} AS (SELECT s.tree, f.doc_id, f.leaf, s.h AS subroot, s.source_tree, s.i, f.f, f.proof "
        f"FROM folded{at} f JOIN s0 s ON s.source_tree = f.tree)",
    ]
    at += 1
    for k in range(root_levels):
        parts += [*level("s", k), fold("s", k, at)]
        at += 1
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, "
        f"f AS folded_root, f = h AS verified FROM folded{at}, s{root_levels}"
    )
