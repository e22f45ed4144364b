"""The subsequence kernel against plain Python, and the machine on held-out documents."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from covermart.llm import queries
from covermart.llm import subsequence_toxicity as st
from llm import brute
from pyspark.sql import functions as F

LARGER = "/root/testdata/sf0.1"
MARKS = ["dimwit", "nitwit", "blockhead", "éclair"]


def test_kernel_equals_plain_python():
    """Words with gaps, inserted, doubled and foreign letters, against every landmark."""
    kernel = st.Kernel(MARKS)
    words = ["dimwit", "dim-wit", "d.i.m.w.i.t", "dimmwit", "dmwit", "wit", "ab", "block head", "éclairs", "漢字漢字", "🙂🙂🙂"]
    got = kernel.of_words(words)
    for word, row in zip(words, got, strict=True):
        edged = [f"\x02{st._OUTER.sub('', w) or w}\x02" for w in (word, *MARKS)]
        want = [brute.shared_subsequences(edged[0], m, st.DECAY, st.GAP) ** st.POWER for m in edged[1:]]
        assert row == pytest.approx([x if x >= st.LEAST else 0 for x in want], abs=1e-4)
    assert got[:2, 0] == pytest.approx([1, got[1, 0]]) and got[1, 0] > 0.2


def test_long_words_are_read_whole():
    """A landmark at any place of a long word is in some window."""
    kernel = st.Kernel(MARKS)
    for place in range(0, 60, 7):
        word = ("1234567" * 9)[:place] + "blockhead" + ("7654321" * 9)[: 60 - place]
        assert kernel.of_words([word])[0].argmax() == 2 and kernel.of_words([word])[0, 2] > 0.015
    assert all(len(w) <= st.WIDEST for w in st.windows("z" * 5000))


def test_sentences_hold_every_word():
    """Lines, marks and long sentences; letters set apart; more words than are held."""
    likeness = st.Likeness(st.Kernel(MARKS), most=10)
    texts = ["clean words here.\na dimwit! " + "w " * 100 + "nitwit", "", " \n\t ", "d i m w i t", "nothing here", "DIMWIT!!"]
    for _ in range(2):
        place, rows = likeness.sentences(texts)
        assert sorted(set(place.tolist())) == [0, 3, 5]
        assert rows[place == 0].max(axis=0)[:2] == pytest.approx([1, 1])
        assert [rows[place == k].max() for k in (3, 5)] == pytest.approx([1, 1])
    assert likeness.sentences([])[1].shape == likeness.sentences([""])[1].shape == (0, len(MARKS))


def labelled(count=400):
    """Texts of which half hold an insult, as made; every id is a text of its own."""
    rows, labels = [], []
    for k in range(count):
        words = brute.prose(k, 40).split()
        if k % 2:
            for at, insult in zip((3, 17, 30), MARKS, strict=False):
                words[at] = insult
        rows.append((k, " ".join(words)))
        labels.append((k, k % 2))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, as_frame):
    rows, labels = labelled()
    return st.fit(spark, as_frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_insults_with_gaps_and_inserted_letters_are_found(spark, as_frame, model):
    said = ["dimwit", "dim-wit", "dimmwit", "dimwitt", "d i m w i t", "DIMWIT!!", "dim_wit"]
    clean = [brute.prose(1000 + k, 40) for k in range(len(said))]
    texts = [f"{c}\nyou {w}. such a {w}\noh {w}" for c, w in zip(clean, said, strict=True)]
    rows = as_frame([*enumerate(texts), *((100 + k, c) for k, c in enumerate(clean))])
    got = {r["doc_id"]: r for r in st.score(rows, model).collect()}
    for k, word in enumerate(said):
        assert got[k]["score"] > 3 * got[100 + k]["score"], word
        assert got[k]["predicted"] == 1 or word not in ("dimwit", "d i m w i t", "DIMWIT!!"), word
    assert all(got[100 + k]["predicted"] == 0 for k in range(len(said)))


def test_awkward_rows(spark, edge_docs, no_docs, as_frame, model):
    """NULLs, empty and very long texts, repeats: each row scored alone; no model scores 0."""
    got = st.score(edge_docs, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= st.LIMIT) for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[4] == by_id[8] == by_id[9] == by_id[10]
    assert st.score(no_docs, model).count() == 0
    assert {r["score"] for r in st.score(edge_docs, None).collect()} == {0.0}


def test_no_labels_no_model(spark, as_frame, no_docs, edge_docs):
    schema = "doc_id long, toxic int"
    for labels in ([], [(7, 1)], [(7, 1), (3, 1)], [(None, 0), (7, 1), (12, None)], [(4, 0), (8, 1)]):
        assert st.fit(spark, edge_docs, spark.createDataFrame(labels, schema)) is None
    assert st.fit(spark, no_docs, spark.createDataFrame([(7, 1), (3, 0)], schema)) is None
    # repeated and contradicting labels, repeated rows
    rows, labels = labelled(60)
    again = spark.createDataFrame([*labels, *labels, (1, 0), (None, 1)], schema)
    assert st.fit(spark, as_frame([*rows, *rows, (None, "x")]), again).landmarks


def test_held_out_documents(spark):
    """Accuracy on the fold that taught nothing."""
    got = queries.op11_subsequence_toxicity(spark, LARGER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{LARGER}/labels.parquet").where("toxic IS NOT NULL"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    toxic = np.array([r["toxic"] == 1 for r in held])
    found = np.array([r["predicted"] == 1 for r in held])
    assert found[toxic].mean() > 0.72
    assert found[~toxic].mean() < 0.03


def test_only_the_text_decides(spark, sf_dir, tmp_path):
    """Other languages, sources and held-out labels leave every score as it was."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    first, second = (brute.order(queries.op11_subsequence_toxicity(spark, d).collect()) for d in (sf_dir, str(tmp_path)))
    assert first == second
