"""The Merkle manifest against plain Python."""

from __future__ import annotations

import zlib

import pytest
from covermart.llm import merkle_manifest as mm
from covermart.llm import queries
from llm import brute
from pyspark.sql import functions as F

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("count", [1, 2, 15, 16, 17, 255, 256, 257, 4096])
def test_addresses_follow_from_subtree_sizes(count):
    """A log by its builder, and each node where the closed form says."""
    leaves = [bytes([k % 251, k // 251]) * 16 for k in range(count)]
    levels = mm.height(count)
    log, nodes, level = mm.appended(leaves, levels), leaves, 0
    total = 0
    while True:
        for k, node in enumerate(nodes):
            at = mm.SIZE * mm.position(level, k, count, levels)
            assert log[at : at + mm.SIZE] == node
        total += len(nodes)
        if len(nodes) == 1:
            break
        nodes = [mm.joined(b"".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        level += 1
    assert len(log) == total * mm.SIZE


def test_query_equals_brute_force(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select(*FIELDS).collect()]
    found = {r[0]: lowered(r[4]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    got = queries.op12_merkle_manifest(spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert brute.order(got.collect()) == brute.order(brute.merkle(rows, found))


def test_trees_of_several_tiers(spark):
    """9,000 rows in one tree and 300 trees of one row: more than one block in both."""
    rows = [(k, "big", None, k, f"Text {k}") for k in range(9000)]
    rows += [(-k, f"s{k:05d}", "en", None, None) for k in range(1, 301)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = mm.document_manifest(spark, docs, F.lower("text"))
    want = brute.merkle(rows, {k: f"text {k}" for k in range(9000)})
    assert brute.order(manifest.proofs().collect()) == brute.order(want)
    blocks = manifest.log.where("tree = '=big'").orderBy("tier", "block").collect()
    assert [(b["tier"], b["block"], b["n"]) for b in blocks] == [(1, 0, 9000), (1, 1, 9000), (1, 2, 9000), (2, 0, 3)]


def test_awkward_rows(spark, edge_docs, no_docs):
    """NULLs, empty and long texts, repeated rows and clashing columns; an empty table."""
    rows = [tuple(r) for r in edge_docs.select(*FIELDS).collect()]
    got = mm.document_manifest(spark, edge_docs).proofs()
    assert got.columns[0] == "id"
    assert brute.order(got.collect()) == brute.order(brute.merkle(rows))
    assert got.where("NOT verified").count() == 0
    nothing = mm.document_manifest(spark, no_docs)
    assert nothing.root is None
    assert nothing.proofs().count() == 0


def test_sources_stand_bytewise_and_apart(spark):
    """NULL, empty and dashed sources differ; order is that of UTF-8 bytes."""
    sources = [None, "", "-", "é", "z", "Z", "￿", "\U00010000"]
    rows = [(k % 5 or None, s, s, 1, "x") for k in range(40) for s in sources]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = mm.document_manifest(spark, docs).proofs().collect()
    assert brute.order(got) == brute.order(brute.merkle(rows))
