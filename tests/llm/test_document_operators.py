"""Operators on documents against plain Python, on supplied rows and on awkward ones."""

from __future__ import annotations

import collections
import zlib

import pytest
import zstandard
from covermart.llm import (
    compression_quality,
    differencing_shards,
    digest_index,
    family_langid,
    minhash_dedup,
    substring_dedup,
)
from covermart.llm.common import Scratch, WordHashes
from llm import brute
from pyspark.sql import functions as F


def ids(rows):
    """Rows of the fixture with ids that occur once."""
    seen = collections.Counter(i for i, _ in rows)
    return [(i, t) for i, t in rows if seen[i] == 1]


# --- repeated passages ---------------------------------------------------------------


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 1])
def test_repeats_of_awkward_rows(spark, edge_docs, edge_rows, group):
    got = substring_dedup.remove_repeats(spark, edge_docs, group=group)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert brute.order(got.drop("kept_text").collect()) == brute.order(brute.removed(edge_rows))


def test_repeats_of_documents(spark, documents, document_rows):
    got = substring_dedup.remove_repeats(spark, documents)
    rows = got.collect()
    assert brute.order(r[:4] for r in rows) == brute.order(brute.removed(document_rows))
    assert all(brute.sha(r["kept_text"]) == r["kept_sha256"] for r in rows)
    assert sum(r["n_removed"] for r in rows) > 0


def test_repeats_without_ids_and_rows(spark, as_frame, null_id_docs, no_docs):
    got = substring_dedup.remove_repeats(spark, as_frame(null_id_docs)).drop("kept_text")
    assert brute.order(got.collect()) == brute.order(brute.removed(null_id_docs))
    assert substring_dedup.remove_repeats(spark, no_docs).count() == 0


def test_short_windows(spark, as_frame):
    rows = [(1, "a b c d e f g h i j k"), (2, "x a b c d e f g h i y"), (3, "a b c d e f g h")]
    got = substring_dedup.remove_repeats(spark, as_frame(rows), size=9).drop("kept_text")
    assert brute.order(got.collect()) == brute.order(brute.removed(rows, 9))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark, as_frame(rows), size=3)


# --- near duplicates -----------------------------------------------------------------


def test_near_duplicates_of_awkward_rows(spark, as_frame, edge_rows):
    rows = ids(edge_rows)
    got = minhash_dedup.near_duplicates(spark, as_frame(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert brute.order(got.collect()) == brute.order(brute.near(rows))


def test_near_duplicates_of_repeated_and_unnamed_rows(spark, as_frame, null_id_docs, no_docs):
    got = minhash_dedup.near_duplicates(spark, as_frame([*null_id_docs, (2, null_id_docs[0][1])]))
    rows = [*null_id_docs, (2, null_id_docs[0][1])]
    assert brute.order(got.collect()) == brute.order(brute.near(rows))
    assert minhash_dedup.near_duplicates(spark, no_docs).count() == 0


def test_rows_without_ids_bridge_and_texts_of_one_id_stand_alone(spark, as_frame):
    def edited(words, places):
        return " ".join(f"e{k}" if k in places else w for k, w in enumerate(words))

    words = [f"w{k}" for k in range(120)]
    other = " ".join(f"x{k}" for k in range(60))
    rows = [
        (7, edited(words, {10, 40})),
        (None, " ".join(words)),
        (None, " ".join(words)),
        (9, edited(words, {70, 100})),
        (9, other),
        (9, other),
        (4, other + " tail"),
        (None, "only one " * 9),
    ]
    got = minhash_dedup.near_duplicates(spark, as_frame(rows))
    expected = brute.near(rows)
    assert [r[2] for r in expected[:5]] == [7, 7, 7, 7, 4]
    assert brute.order(got.collect()) == brute.order(expected)


def test_near_duplicates_of_documents(spark, documents, document_rows):
    got = minhash_dedup.near_duplicates(spark, documents)
    assert brute.order(got.collect()) == brute.order(brute.near(document_rows))


def test_chain_of_links_and_a_large_family(spark, as_frame):
    """A chain whose ends differ, and many edits of one text that are partly not linked."""
    import random

    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(12):  # each differs from the next by a few words at one place
        base = base.copy()
        base[k * 9] = f"new{k}"
        rows.append((100 + k, " ".join(base)))
    draw = random.Random(5)
    for k in range(150):
        text = [f"v{i}" for i in range(100)]
        for _ in range(draw.randint(0, 6)):
            text[draw.randrange(100)] = f"e{draw.randrange(10**6)}"
        rows.append((1000 + k, " ".join(text)))
    got = minhash_dedup.near_duplicates(spark, as_frame(rows))
    assert brute.order(got.collect()) == brute.order(brute.near(rows))


def test_estimates_follow_similarity():
    """The corrected share of equal lanes is close to the similarity."""
    import numpy as np

    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(values[:2400]), np.unique(values[600:])
    true = 1800 / 3000
    minima = minhash_dedup._minima([a, b], minhash_dedup.MORE_LANES)
    low = minima & (2**minhash_dedup.MORE_BITS - 1)
    chance = 1 / 2**minhash_dedup.MORE_BITS
    estimate = ((low[0] == low[1]).mean() - chance) / (1 - chance)
    assert abs(estimate - true) < 0.08


# --- quality -------------------------------------------------------------------------


def test_quality_counts(edge_docs, edge_rows, documents, document_rows, no_docs, as_frame, null_id_docs):
    for docs, rows in ((edge_docs, edge_rows), (documents, document_rows), (as_frame(null_id_docs), null_id_docs)):
        got = compression_quality.quality(docs).collect()
        counts = [(r["doc_id"], *r[1:7]) for r in got]
        assert brute.order(counts) == brute.order((i, *brute.quality(t)) for i, t in rows)
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert compression_quality.quality(no_docs).count() == 0


def test_compression_bands():
    packer, hashes = zstandard.ZstdCompressor(level=3), WordHashes()

    def verdict(text: str):
        return compression_quality.measure(text.encode(), compression_quality.BANDS, 4096, hashes, packer)

    import random

    draw = random.Random(1)
    assert verdict(brute.prose(3, 3000))[6]
    assert verdict(brute.prose(4, 40))[6]
    repeated = " ".join(f"{w} {w} {w} {w} {w} {w} {w}" for w in brute.prose(5, 12).split())
    assert not verdict(repeated)[5] and not verdict(repeated)[6]  # only the band sees it
    noise = " ".join("".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(9)) for _ in range(400))
    assert not verdict(noise)[5] and not verdict(noise)[6]
    half = brute.prose(6, 1500) + " " + " ".join(["word"] * 7 + ["other"] * 7) * 120
    whole, chunked = verdict(half)[7], verdict(half)[8]
    assert whole > 2 and chunked > compression_quality.BAD_SHARE  # a chunk is out of band


def test_bands_follow_the_table(spark, sf_dir, as_frame):
    """Encoded bytes, line templates and most junk go, clean text of each length stays."""
    import base64
    import random

    folder = sf_dir.replace("sf0.001", "sf0.1")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdicts = compression_quality.quality(documents).where("NOT base_failed").join(labels, "doc_id")
    rows = verdicts.select("quality", F.col("kept").cast("int").alias("kept")).collect()
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.995 * len(kept[1]) and sum(kept[0]) <= 0.5 * len(kept[0])

    draw = random.Random(2)
    words = brute.prose(8, 3000).split()

    def wrapped(raw):
        return "\n".join(raw[i : i + 64] for i in range(0, len(raw), 64))

    def spam(size):
        lines = ""
        while len(lines) < size:
            lines += f"buy {draw.choice(words)} online cheap {draw.choice(words)} best price\n"
        return lines

    junk = [spam(n) for n in (1400, 5000, 20_000, 91_000)]
    junk += [wrapped(base64.b64encode(draw.randbytes(n)).decode()) for n in (1100, 6000, 40_000)]
    junk += [wrapped(draw.randbytes(n).hex()) for n in (1500, 4000, 40_000)]
    packer, hashes = zstandard.ZstdCompressor(level=3), WordHashes()
    limits = compression_quality.limits(documents)
    for text in junk:
        found = compression_quality.measure(text.encode(), limits, 4096, hashes, packer)
        assert not found[5] and not found[6], (text[:30], len(text), found)


def test_bands_count_copies_once_and_scripts_apart(spark, as_frame):
    import random

    draw = random.Random(3)
    words = brute.prose(9, 3000).split()
    latin = [" ".join(draw.choices(words, k=60 + k)) for k in range(300)]
    cyrillic = [x.translate(str.maketrans("etaoinshrdlucmfw", "етаоинсхрдлуцмфв")) for x in latin[:120]]
    spam = "".join(f"buy {x} online cheap {y} best price\n" for x, y in zip(words, words[50:80]))
    rows = list(enumerate(latin + cyrillic + [spam] * 2000))
    got = {r["doc_id"]: r["kept"] for r in compression_quality.quality(as_frame(rows)).collect()}
    assert sum(not got[i] for i in range(420)) <= 4
    assert not any(got[i] for i in range(420, len(rows)))


def test_keep_leaves_columns_alone(edge_docs, no_docs):
    kept = compression_quality.keep(edge_docs)
    assert kept.schema == edge_docs.schema
    verdicts = {r["doc_id"] for r in compression_quality.quality(edge_docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdicts
    assert compression_quality.keep(no_docs).count() == 0


# --- exact copies --------------------------------------------------------------------


def index(spark, path=None):
    return digest_index.DigestIndex(spark, path or Scratch(spark, "index").folder, buckets=4)


def test_digest_index_of_one_batch(spark, edge_docs, edge_rows, as_frame, null_id_docs, no_docs):
    assert brute.order(index(spark).add(edge_docs).collect()) == brute.order(brute.exact(edge_rows))
    got = index(spark).add(as_frame(null_id_docs)).collect()
    want = brute.exact(null_id_docs)
    assert brute.order((*r[:3], r[4]) for r in got) == brute.order((*r[:3], r[4]) for r in want)
    assert sum(r["kept"] for r in got) == 3  # one of each text, also where no row has an id
    assert index(spark).add(no_docs).count() == 0


def test_digest_index_keeps_what_it_has_seen(spark, as_frame):
    path = Scratch(spark, "index").folder
    first = index(spark, path).add(as_frame([(5, "a  b"), (6, "c"), (7, "a b")])).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in first} == {(5, 5, True), (6, 6, True), (7, 5, False)}
    spark.sql(f"DROP TABLE {index(spark, path).name}")  # the folder outlives the catalogue
    again = index(spark, path)
    second = {r["doc_id"]: r for r in again.add(as_frame([(1, "a\tb"), (2, "d"), (3, "d")])).collect()}
    assert (second[1]["keep_id"], second[1]["kept"], second[1]["group_size"]) == (5, False, 3)
    assert (second[2]["kept"], second[3]["kept"], second[3]["keep_id"]) == (True, False, 2)
    assert again.entries().count() == 3
    plan = again.entries().hint("merge").join(
        again.entries().hint("merge"), "digest"
    )._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # buckets meet without a shuffle


# --- shards --------------------------------------------------------------------------


def check_shards(rows, got, shards):
    assert brute.order((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == brute.order(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark, documents, document_rows, edge_docs, edge_rows, as_frame, null_id_docs, no_docs):
    got = differencing_shards.shard_documents(spark, documents).collect()
    check_shards(document_rows, got, 8)
    text, homes, sums = dict(document_rows), collections.defaultdict(set), collections.Counter()
    for r in got:
        homes[text[r["doc_id"]]].add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in homes.values())
    largest = max(collections.Counter(text[r["doc_id"]] for r in got for _ in [0]).values())
    assert largest >= 1 and max(sums.values()) - min(sums.values()) <= 64
    check_shards(edge_rows, differencing_shards.shard_documents(spark, edge_docs, 3).collect(), 3)
    check_shards(null_id_docs, differencing_shards.shard_documents(spark, as_frame(null_id_docs)).collect(), 8)
    assert differencing_shards.shard_documents(spark, no_docs).count() == 0


def test_differencing_by_hand():
    assert differencing_shards.difference([], 3) == []
    homes = differencing_shards.difference([8, 7, 6, 5, 4], 2)
    sums = [sum(w for w, h in zip([8, 7, 6, 5, 4], homes, strict=True) if h == s) for s in (0, 1)]
    assert sorted(sums) == [14, 16]  # the known result of differencing, one off the best
    weights = [1_000_000, *range(1, 2000)]
    homes = differencing_shards.difference(weights, 4)
    sums = sorted(sum(w for w, h in zip(weights, homes, strict=True) if h == s) for s in range(4))
    assert sums[3] == 1_000_000 and sums[2] - sums[0] <= 1


def test_small_groups_are_pooled(spark, as_frame, monkeypatch):
    monkeypatch.setattr(differencing_shards, "GRAIN", 2)
    rows = [(i, f"text {i % 90} " + "x" * (i % 13)) for i in range(400)] + [(999, "y" * 4000)]
    got = differencing_shards.shard_documents(spark, as_frame(rows), 4).collect()
    check_shards(rows, got, 4)


# --- language ------------------------------------------------------------------------


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    fold = family_langid.held_out("doc_id")
    model = family_langid.fit(spark, docs.where(~fold))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = family_langid.predict(docs, model).select("*", fold.alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["out"]]
    assert len(held) > 150
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    # only the text decides
    blind = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    blind = blind.withColumn("doc_id", F.col("doc_id") + 100_000)
    other = {r["doc_id"] - 100_000: (r["lang_pred"], r["score"]) for r in family_langid.predict(blind, model).collect()}
    assert other == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}


def test_language_of_awkward_rows(spark, edge_docs, no_docs):
    model = family_langid.fit(spark, edge_docs)  # one language: nothing to decide between
    got = {r["doc_id"]: r for r in family_langid.predict(edge_docs, model).collect()}
    for i in (4, 9, 10, 33):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[7]["lang_pred"] == "en"
    assert family_langid.fit(spark, no_docs) is None
    assert family_langid.predict(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in family_langid.predict(edge_docs, None).collect()} == {"und"}


def test_related_languages_are_decided_within_their_family():
    import numpy as np

    texts = {"en": "the and of to", "de": "der und die zu", "fr": "le et de la", "es": "el y de los"}
    x, y = [], []
    for lang, marks in texts.items():
        for k in range(12):
            x.append(family_langid.features(f"{marks} {brute.prose(k, 5)} {marks}"))
            y.append(lang)
    model = family_langid.LanguageModel(np.array(x), y)
    assert model.top.classes == ["germanic", "romance"]
    assert model.within["romance"].classes == ["es", "fr"]
    assert model.predict(np.array(x))[0] == y
    assert family_langid.family("zz") == "zz"
