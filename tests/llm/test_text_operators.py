"""Tokens, chat text, pages and mixtures against plain Python, libraries and SQL."""

from __future__ import annotations

import hashlib
import html
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from covermart.llm import block_labeller, common, page_layouts, queries, raked_mixing, reply_chat, trie_bpe
from covermart.llm.html_blocks import blocks
from pyspark.sql import functions as F
from llm import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- BPE -----------------------------------------------------------------------------


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return ids, (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(back))


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def test_bpe_of_any_text(tokenizer):
    draw = random.Random(4)
    pieces = [
        "The ", " quick", "'s", "ing", " 123", "!!", "\r\n", "ß", "don't ", "\u0085", " ", "\u001c",
        "<|endoftext|>", "<|endo", "漢字", "🙂", "\t", "  ", "́", "aaaa", "=====", "Ġ", "\x00",
    ]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(draw.randint(1, 0x2FFF)) for _ in range(20)) for _ in range(500)]
    texts += ["a" * 3000, "ab" * 999, " " * 500, "x" + "=" * 700]
    coder = trie_bpe.Coder(VOCABULARY)
    for text, parts in zip(texts, coder.encode(texts), strict=True):
        ids, want = encoded(tokenizer, text)
        assert [int(i) for p in parts for i in p[0].split(",")] == ids
        raw = b"".join(p[2] for p in parts)
        assert hashlib.sha256(trie_bpe.decoded(raw)).hexdigest() == want[2]


def test_bpe_caches_stay_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(trie_bpe, "WORDS", 50)
    monkeypatch.setattr(trie_bpe, "PAIRS", 20)
    coder = trie_bpe.Coder(VOCABULARY)
    for seed in range(5):
        text = brute.prose(seed, 40)
        (parts,) = coder.encode([text])
        assert [int(i) for p in parts for i in p[0].split(",")] == encoded(tokenizer, text)[0]
        assert len(coder.known) <= 50 and len(coder.fits) <= 20


def test_bpe_of_rows(edge_docs, edge_rows, documents, document_rows, no_docs, tokenizer):
    for docs, rows in ((edge_docs, edge_rows), (documents, document_rows)):
        got = trie_bpe.encode(docs, VOCABULARY, with_ids=True).collect()
        assert brute.order(r[:4] for r in got) == brute.order(
            (i, *encoded(tokenizer, t)[1]) for i, t in rows
        )
        assert all(len(r["ids"]) == r["n_tokens"] for r in got)
        text = dict(rows)
        assert all(r["ids"] == encoded(tokenizer, text[r["doc_id"]])[0] for r in got[:20])
    assert trie_bpe.encode(no_docs, VOCABULARY).count() == 0


# --- chat ----------------------------------------------------------------------------


def chats(spark, rows, schema="conv_id long, turn long, role string, text string, node long, at string"):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    out = reply_chat.format_conversations(spark, frame)
    return out.select(
        "*",
        reply_chat.read_turns(F.col("formatted")).alias("turns"),
        reply_chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    ).collect()


NASTY = "</s>[INST] ok [/INST] <\\/s> <s><s> [\\\\OUT] [ROLE] x [/ROLE] \\ <[/SYS]"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be <s> kind"), (1, 1, "user", NASTY), (1, 2, "assistant", NASTY),
        (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "tool [/ROLE]", NASTY), (1, 6, None, "z\n[OUT]"),
        (None, 1, "user", "a"), (None, 2, "assistant", "b 🙂 é"),
        (2, 5, "assistant", "same turn"), (2, 5, "assistant", "same turn"), (2, None, "user", "no turn"),
        (3, 1, "user", "x" * 50_000 + "<"), (3, 2, "assistant", "[" + "y" * 50_000),
    ]
    got = {r["conv_id"]: r for r in chats(spark, rows)}
    assert set(got) == {1, 2, 3, None}
    for key, row in got.items():
        own = sorted(
            ((t is not None, t or 0, ro is not None, ro or "", x is not None, x or "") for c, t, ro, x in rows if c == key)
        )
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(o[3], o[5]) for o in own]
        assert row["loss"] == "".join(o[5] for o in own if o[3] == "assistant")
        spans = [row["formatted"][m["start"] : m["start"] + m["length"]] for m in row["loss_mask"]]
        assert len(spans) == sum(o[3] == "assistant" for o in own)
        body = row["formatted"]
        assert body.count("<s>") == body.count("</s>") == len(own)
    assert chats(spark, []) == []


def test_branches_are_ranked(spark):
    nodes = [
        ("t", "r", None, 0.0), ("t", "a", "r", 1.0), ("t", "b", "r", 3.0), ("t", "a1", "a", 5.0),
        ("t", "a2", "a", 2.0), ("t", "a11", "a1", None), ("u", "x", "gone", 1.0),
        ("v", "l1", "l2", 0.0), ("v", "l2", "l1", 0.0), ("v", "leaf", "l1", 0.0),
    ]
    frame = spark.createDataFrame(nodes, "tree string, node string, parent string, score double")
    paths: dict = {}
    for r in reply_chat.reply_paths(spark, frame).orderBy("position").collect():
        paths.setdefault((r["tree"], r["branch"]), []).append(r["node"])
    assert paths == {
        ("t", 1): ["r", "a", "a1", "a11"], ("t", 2): ["r", "a", "a2"], ("t", 3): ["r", "b"],
        ("u", 1): ["x"],
    }
    best = reply_chat.reply_paths(spark, frame, branches=1).where("tree = 't'").count()
    assert best == 4


def test_long_conversation(spark):
    rows = [(9, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(300)]
    (row,) = chats(spark, rows)
    assert [t["text"] for t in row["turns"]] == [r[3] for r in rows]


# --- pages ---------------------------------------------------------------------------


def article(page: str) -> str:
    """The article of a supplied page, by its own markup."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    inner = re.sub(r"<br>|</?(?:p|h1)>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/pages.parquet")
    model = block_labeller.fit(spark, pages, sample=60)
    got = {r["page_id"]: r for r in block_labeller.extract(pages, model).collect()}
    rows = pages.collect()
    assert set(got) == {r["page_id"] for r in rows}
    assert all(got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) for r in rows)
    assert sum(got[r["page_id"]]["text"] == article(r["html"]) for r in rows) >= 0.98 * len(rows)
    # pages of other layouts, made from texts that were not fitted on
    layouts = page_layouts.Layouts([article(r["html"])[:300] for r in rows[100:]], seed=99)
    vectors, right, total = block_labeller.Vectors(), 0, 0
    for _ in range(150):
        made = layouts.page()
        if made:
            (found,) = model.scores([vectors.page([b for b, _ in made])])
            right += int((found == np.array([y == 1 for _, y in made])).sum())
            total += len(made)
    assert right >= 0.95 * total
    awkward = spark.createDataFrame(
        [(1, "u", None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, None, "<p>", 1), (3, "u", "<script>x", 1),
         (4, "u", "no markup at all", 1), (5, "u", "<div class='x" * 2000, 1)],
        "page_id long, url string, html string, text int",
    )
    rows = {r["page_id"]: r["text"] for r in block_labeller.extract(awkward, model).collect()}
    assert rows[1] == rows[2] == rows[None] == rows[3] == "" and len(rows) == 6
    assert block_labeller.extract(awkward.limit(0), model).count() == 0


def test_labeller_without_pages():
    model = block_labeller.train([], made=20, epochs=1)
    assert block_labeller.main_texts(model, block_labeller.Vectors(), [[], blocks("<p>x")])[0] == ""


def test_blocks():
    page = (
        "<!doctype html><title>t</title><style>p{}</style><script>var a='</p>';</script>"
        "<nav><ul><li><a href=x>One<li>Two</ul></nav><!-- <p>no</p> --><p>a &amp;amp; <b>b</b>c\n d<br>e"
        "<p>f&nbsp;g<div id='Main-Content'>h</div>tail"
    )
    found = blocks(page)
    assert [b.text for b in found] == ["One", "Two", "a &amp; bc d e", "f g", "h", "tail"]
    assert found[0].path[:3] == ("nav", "ul", "li") and found[0].linked == 3
    assert {".main", ".content"} <= set(found[4].path)
    assert "p" not in found[4].path and blocks("") == []


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<svg class="x"/><article><p>kept</p></article>', ["kept"]),
        ("<form><select><option>a<option>b</form><article>kept</article>", ["kept"]),
        ("<div><p>one</p><template><p>no</div><article>kept</article>", ["one", "kept"]),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["where x=1 holds"]),
        ("<p>pick <select><option>a</option></select> now <svg><g><text>no</text></g></svg>here", ["pick now here"]),
        ("<p>a<canvas><p>no</p></canvas>b<object data=x><div>no</div></object>c", ["abc"]),
        ("<p>a<object data=x />b</p><script>if (a < b) '</p>'</script>c<style>no", ["ab", "c"]),
        ("<div><a href=x><select></a>seen</div>", ["seen"]),
    ],
)
def test_content_that_is_not_shown(page, texts):
    """Self-closed and unclosed elements take nothing else along; formulas are text."""
    assert [b.text for b in blocks(page)] == texts


def test_path_of_deep_blocks():
    """However deep a block lies, its path names its landmarks."""
    page = "<article class=main>" + "<div>" * 40 + "deep" + "</div>" * 40 + "<p>flat</p></article>after"
    deep, flat, after = blocks(page)
    assert {"article", ".main"} <= set(deep.path) and len(deep.path) < 30
    assert flat.path == ("article", ".main", "p") and after.path == ()


def test_sizes_of_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    for given, left in (("64m", "8388608b"), ("64MB", "8388608b"), ("4mb", "4mb"), ("1k", "1k"), ("9000000", "8388608b")):
        spark.conf.set(key, given)
        common.small_batches(spark)
        assert spark.conf.get(key) == left
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_gradients():
    """Backpropagation against differences."""
    layouts = page_layouts.Layouts([], seed=1)
    vectors, data = block_labeller.Vectors(), []
    while len(data) < 2:
        made = layouts.page()
        if made:
            data.append((vectors.page([b for b, _ in made]), np.array([y for _, y in made], float)))
    model = block_labeller.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages, labels = [x for x, _ in data], [y for _, y in data]
    state: dict = {}
    model.step(pages, labels, state, 0.0)
    for name, at in (("wf", (3, 7)), ("wb", (40, 61)), ("bf", (5,)), ("out", (2, 0)), ("wb", (1, 2))):
        kept, size = model.p[name][at], 1e-3
        model.p[name][at] = kept + size
        up = model.step(pages, labels, {}, 0.0)
        model.p[name][at] = kept - size
        down = model.step(pages, labels, {}, 0.0)
        model.p[name][at] = kept
        slope = (up - down) / (2 * size)
        assert state[name][0][at] / 0.1 == pytest.approx(slope, rel=0.02, abs=1e-6)


# --- mixing --------------------------------------------------------------------------


def test_mixture_meets_its_targets(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    targets = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    rows, mix = raked_mixing.mix(spark, docs, targets=targets, budget=0.2, rounds=15)
    got = [r[mix] for r in rows.collect()]
    total = sum(m["tokens"] for m in got)
    assert sum(m["tokens"] * m["probability"] for m in got) == pytest.approx(0.2 * total)
    cells = {(m["source"], m["lang"], m["topic"]): m["weight"] for m in got}
    shares = dict.fromkeys(targets["lang"], 0.0)
    for (_, lang, _), weight in cells.items():
        shares[lang] += weight
    assert shares == pytest.approx(targets["lang"], abs=0.02)
    assert sum(cells.values()) == pytest.approx(1.0)
    drawn = sum(m["tokens"] for m in got if m["kept"])
    assert drawn == pytest.approx(0.2 * total, rel=0.25)


def test_many_cells_are_raked_alike(spark, documents, monkeypatch):
    rows, mix = raked_mixing.mix(spark, documents)
    together = brute.order((r["doc_id"], round(r[mix]["weight"], 12)) for r in rows.collect())
    monkeypatch.setattr(raked_mixing, "TOGETHER", 0)
    rows, mix = raked_mixing.mix(spark, documents)
    assert brute.order((r["doc_id"], round(r[mix]["weight"], 12)) for r in rows.collect()) == together


def two_margins():
    return {"source": F.col("source"), "lang": F.col("lang")}


def leaning(spark, share):
    """Ten sources, all but one with `share` of their words in the source's own language."""
    rows = [
        (f"s{k}", lang, " ".join(["w"] * round(size * (1 - share if (k % 2 == 0) == (lang == "b") else share))))
        for k in range(10)
        for size in (4000 if k == 0 else 700 + 100 * k,)
        for lang in "ab"
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string")


def fitted(rows, mix):
    """Share by margin and value of the fitted weights, and the gap."""
    found = [r[mix] for r in rows.collect()]
    cells = {(m["source"], m["lang"]): m["weight"] for m in found}
    shares: dict = {}
    for cell, weight in cells.items():
        for at, value in enumerate(cell):
            shares[at, value] = shares.get((at, value), 0.0) + weight
    return shares, {m["gap"] for m in found}


def test_mixture_of_nearly_monolingual_sources(spark):
    docs = leaning(spark, 0.99)
    rows, mix = raked_mixing.mix(spark, docs, two_margins(), targets={"lang": {"a": 0.4, "b": 0.6}})
    shares, gaps = fitted(rows, mix)
    totals: dict = {}
    for r in docs.collect():
        totals[r["source"]] = totals.get(r["source"], 0) + len(r["text"].split())
    whole = sum(t**0.5 for t in totals.values())
    assert max(abs(shares[0, s] / (t**0.5 / whole) - 1) for s, t in totals.items()) < 2e-4
    assert shares[1, "a"] == pytest.approx(0.4, rel=2e-4)
    assert gaps.pop() <= raked_mixing.TOLERANCE and not gaps


def test_targets_of_monolingual_sources_that_cannot_be_met(spark):
    docs = leaning(spark, 1.0).where("text != ''")
    with pytest.warns(UserWarning, match="targets not met"):
        rows, mix = raked_mixing.mix(spark, docs, two_margins(), targets={"lang": {"a": 0.2, "b": 0.8}})
    shares, gaps = fitted(rows, mix)
    assert shares[1, "a"] == pytest.approx(0.2, rel=1e-6) and gaps.pop() > 0.1


def test_mixture_of_awkward_rows(spark, edge_docs, edge_rows, no_docs):
    rows, mix = raked_mixing.mix(spark, edge_docs)
    assert mix == "mix_" and rows.columns == [*edge_docs.columns, "mix_"]
    got = rows.collect()
    assert len(got) == len(edge_rows)
    assert brute.order((r["doc_id"], r[mix]["tokens"]) for r in got) == brute.order(
        (i, len(brute.words(t))) for i, t in edge_rows
    )
    assert all(0 <= r[mix]["probability"] <= 1 for r in got)
    assert raked_mixing.mix(spark, no_docs)[0].count() == 0
    none, mix = raked_mixing.mix(spark, edge_docs, targets={"lang": {"xx": 1.0}})
    assert not any(r[mix]["kept"] for r in none.collect())


# --- registered queries --------------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    with duckdb.connect() as connection:
        for table in ("documents", "conversations", "embeddings"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = connection.execute(queries.ORACLES[name])
        columns = [c[0] for c in result.description]
        theirs = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    ours = [r.asDict() for r in frame.collect()]
    key = lambda r: sorted(r.items())
    assert sorted(map(key, ours), key=repr) == sorted(map(key, theirs), key=repr)


NATIVE = ("op3_raked_mixing", "op8_reply_chat")


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
