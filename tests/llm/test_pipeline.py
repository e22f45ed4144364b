"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import corpus_pipeline as cp
import tokenizers
from covermart.llm import compression_quality, raked_mixing
from llm import brute


def walk(spark, docs, sf_dir, tmp_path):
    """Input and output of every stage, each written and read again."""
    steps = []
    for at, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{at}")
        after = spark.read.parquet(f"{tmp_path}/{at}")
        steps.append((name, docs, after))
        docs = after
    return steps


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def check(steps, columns):
    (_, raw, good), (_, _, exact), (_, _, near), (_, _, mixed), (_, _, tokens) = steps
    for frame in (good, exact, near, mixed):
        assert frame.columns == columns
    verdicts = compression_quality.quality(raw).collect()
    assert brute.order([(r["doc_id"],) for r in verdicts if r["kept"]]) == brute.order(
        [(i,) for i, _ in pairs(good)]
    )
    rows = pairs(good)
    stays: dict = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        stays.setdefault(brute.SPACE.sub(" ", t or ""), i)
    assert brute.order([(i,) for i in stays.values()]) == brute.order([(i,) for i, _ in pairs(exact)])
    named = [(i, t) for i, t in pairs(exact) if i is not None]
    kept = {i for i, _, _, yes in brute.near(named) if yes}
    assert {i for i, _ in pairs(near) if i is not None} == kept
    before = {i for i, _ in pairs(near)}
    assert {i for i, _ in pairs(mixed)} <= before
    tokenizer = tokenizers.Tokenizer.from_file(cp.VOCABULARY)
    text = dict(pairs(mixed))
    got = tokens.collect()
    assert len(got) == len(pairs(mixed))
    for r in got:
        assert r["ids"] == tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids


def test_documents(spark, documents, sf_dir, tmp_path):
    steps = walk(spark, documents, sf_dir, tmp_path)
    check(steps, documents.columns)
    counts = [after.count() for _, _, after in steps]
    assert documents.count() > counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > 0
    rows, mix = raked_mixing.mix(spark, steps[2][2])
    drawn = {r["doc_id"] for r in rows.where(f"{mix}.kept").collect()}
    assert drawn == {i for i, _ in pairs(steps[3][2])}


def test_awkward_rows(spark, edge_docs, sf_dir, tmp_path):
    check(walk(spark, edge_docs, sf_dir, tmp_path), edge_docs.columns)


def test_rows_without_ids_go_through(spark, as_frame, null_id_docs, sf_dir, tmp_path):
    steps = walk(spark, as_frame(null_id_docs), sf_dir, tmp_path)
    assert sorted(pairs(steps[2][2]), key=repr) == sorted(
        [(2, null_id_docs[0][1]), (None, null_id_docs[2][1])], key=repr
    )


def test_texts_of_one_id_are_judged_apart(spark, as_frame, sf_dir):
    """Of two texts under id 9 one is a near copy of id 7, the other stands alone; id 3 has near copies."""
    a, b, c = brute.prose(91, 90), brute.prose(92, 90), brute.prose(93, 90)
    rows = [(7, a), (9, a + " tail"), (9, b), (3, c), (3, c + " tail"), (None, b + " end")]
    kept = pairs(cp.near_dedup(spark, as_frame(rows), sf_dir))
    assert {i: sum(1 for k, _ in kept if k == i) for i in (7, 9, 3, None)} == {7: 1, 9: 1, 3: 1, None: 0}
    assert (9, b) in kept


def test_no_rows(spark, no_docs, sf_dir, tmp_path):
    assert all(after.count() == 0 for _, _, after in walk(spark, no_docs, sf_dir, tmp_path))


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    assert {f"op{n}_" for n in range(1, 14)} == {
        x.split("_")[0] + "_" for x in names if x.startswith("op") and x[2].isdigit()
    }
    assert set(entry.oracle_sql()) <= names
