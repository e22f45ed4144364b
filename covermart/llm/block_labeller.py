"""Main text of web pages by a recurrent labeller of blocks.

A page is a sequence of leaf blocks. Each block is a vector: averaged embeddings of the hashed
names on its path of tags and of its hashed words, and a few measures of its text. An LSTM
reads the sequence forwards, another backwards, so every block is classified with the whole
page in view. The network is plain numpy; it is fitted on a bounded sample of pages: texts
that their own semantic elements mark as article, set in layouts drawn at random.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.html_blocks import Block, blocks
from covermart.llm.page_layouts import Layouts, guessed

#: Pages drawn from the table, and pages made from their texts, to fit on.
SAMPLE, MADE = 200, 700
PATHS, WORDS, WIDTH, HIDDEN, MEASURES = 1024, 2048, 12, 20, 10
EPOCHS, BATCH, RATE = 6, 32, 0.01


def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


class Vectors:
    """Blocks as hashed names, hashed words and measures; names seen are remembered, boundedly."""

    def __init__(self):
        self.paths: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _of(self, known: dict[str, int], name: str, size: int) -> int:
        found = known.get(name)
        if found is None:
            if len(known) >= 200_000:
                known.clear()
            found = known[name] = _bucket(name, size)
        return found

    def page(self, found: list[Block]):
        """(path buckets, word buckets, measures), one entry per block."""
        paths, words = [], []
        measures = np.zeros((len(found), MEASURES), np.float32)
        for row, block in enumerate(found):
            text, split = block.text, block.text.split(" ")
            paths.append([self._of(self.paths, x, PATHS) for x in (*block.path, "^" + "/".join(block.path[-2:]))])
            words.append([self._of(self.words, x, WORDS) for x in split])
            size = len(text)
            measures[row] = (
                1.0,
                np.log1p(size) / 6,
                np.log1p(len(split)) / 5,
                min(1.0, block.linked / size),
                sum(map(text.count, ".,;:!?")) / size * 10,
                sum(map(text.count, "0123456789")) / size * 5,
                text[-1] in ".!?",
                text[:1].isupper(),
                row / len(found),
                1 / len(found),
            )
        return paths, words, measures


class Labeller:
    """The network: embeddings, two LSTMs and a logistic output."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        size = 2 * WIDTH + MEASURES
        normal = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "path": normal(PATHS, WIDTH, by=0.3),
            "word": normal(WORDS, WIDTH, by=0.1),
            "out": normal(2 * HIDDEN, 1, by=0.2),
            "out_b": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.p[f"w{way}"] = normal(size + HIDDEN, 4 * HIDDEN, by=(size + HIDDEN) ** -0.5)
            self.p[f"b{way}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1.0

    def _input(self, pages):
        """Padded (time, page, feature), the mask, and what the gradient needs."""
        longest = max(len(m) for _, _, m in pages)
        x = np.zeros((longest, len(pages), 2 * WIDTH + MEASURES), np.float32)
        mask = np.zeros((longest, len(pages), 1), np.float32)
        bags = []
        for k, (paths, words, measures) in enumerate(pages):
            n = len(measures)
            mask[:n, k] = 1
            x[:n, k, 2 * WIDTH :] = measures
            for at, table, lists in ((0, "path", paths), (WIDTH, "word", words)):
                flat = np.fromiter((i for row in lists for i in row), np.int64)
                counts = np.array([len(row) for row in lists])
                starts = np.cumsum(counts) - counts
                x[:n, k, at : at + WIDTH] = np.add.reduceat(self.p[table][flat], starts) / counts[:, None]
                bags.append((table, at, k, n, flat, counts))
        return x, mask, bags

    def _run(self, way: str, x, mask, keep: bool):
        w, b = self.p[f"w{way}"], self.p[f"b{way}"]
        steps, n, size = x.shape
        part = x.reshape(-1, size) @ w[:size] + b
        part = part.reshape(steps, n, -1)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, cache = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            gates = part[t] + h @ w[size:]
            sig = 1 / (1 + np.exp(-gates))
            i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 3 * HIDDEN :]
            g = np.tanh(gates[:, 2 * HIDDEN : 3 * HIDDEN])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            new_h = o * tanh_c
            if keep:
                cache.append((h, c, i, f, g, o, tanh_c))
            m = mask[t]
            h, c = m * new_h + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        return out, cache

    def scores(self, pages, keep: bool = False):
        x, mask, bags = self._input(pages)
        forward, cache_f = self._run("f", x, mask, keep)
        backward, cache_b = self._run("b", x[::-1], mask[::-1], keep)
        hidden = np.concatenate([forward, backward[::-1]], axis=2)
        logit = hidden @ self.p["out"] + self.p["out_b"]
        if not keep:
            return [logit[: len(m), k, 0] > 0 for k, (_, _, m) in enumerate(pages)]
        return logit, (x, mask, bags, hidden, cache_f, cache_b)

    def _back(self, way: str, x, mask, cache, grad_h, grads):
        w = self.p[f"w{way}"]
        steps, n, size = x.shape
        gates = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        recurrent = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, g, o, tanh_c = cache[t]
            m = mask[t]
            dh = dh + grad_h[t]
            own_h, own_c = m * dh, m * dc
            own_c = own_c + own_h * o * (1 - tanh_c**2)
            d = gates[t]
            d[:, :HIDDEN] = own_c * g * i * (1 - i)
            d[:, HIDDEN : 2 * HIDDEN] = own_c * c * f * (1 - f)
            d[:, 2 * HIDDEN : 3 * HIDDEN] = own_c * i * (1 - g**2)
            d[:, 3 * HIDDEN :] = own_h * tanh_c * o * (1 - o)
            recurrent += h.T @ d
            dh = (1 - m) * dh + d @ w[size:].T
            dc = (1 - m) * dc + own_c * f
        flat = gates.reshape(-1, 4 * HIDDEN)
        grads[f"w{way}"] = np.vstack([x.reshape(-1, size).T @ flat, recurrent])
        grads[f"b{way}"] = flat.sum(axis=0)
        return (flat @ w[:size].T).reshape(x.shape)

    def step(self, pages, labels, state: dict, rate: float) -> float:
        """One step of Adam on a batch; the loss."""
        logit, (x, mask, bags, hidden, cache_f, cache_b) = self.scores(pages, keep=True)
        truth = np.zeros_like(logit)
        for k, y in enumerate(labels):
            truth[: len(y), k, 0] = y
        chance = 1 / (1 + np.exp(-logit))
        total = mask.sum()
        loss = -(mask * (truth * np.log(chance + 1e-7) + (1 - truth) * np.log(1 - chance + 1e-7))).sum() / total
        d = (chance - truth) * mask / total
        grads = {
            "out": hidden.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1),
            "out_b": d.sum(axis=(0, 1)),
        }
        dh = d @ self.p["out"].T
        dx = self._back("f", x, mask, cache_f, dh[:, :, :HIDDEN], grads)
        dx += self._back("b", x[::-1], mask[::-1], cache_b, dh[::-1, :, HIDDEN:], grads)[::-1]
        for table in ("path", "word"):
            grads[table] = np.zeros_like(self.p[table])
        for table, at, k, n, flat, counts in bags:
            share = dx[:n, k, at : at + WIDTH] / counts[:, None]
            np.add.at(grads[table], flat, np.repeat(share, counts, axis=0))
        state["t"] = state.get("t", 0) + 1
        for name, g in grads.items():
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = (m, v)
            unbiased = m / (1 - 0.9 ** state["t"])
            self.p[name] -= (rate * unbiased / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)).astype(np.float32)
        return float(loss)


def train(pages: list[str], made: int = MADE, epochs: int = EPOCHS, seed: int = 0) -> Labeller:
    """A labeller fitted on pages with an article and on random layouts of their texts."""
    real = [x for x in map(guessed, pages) if x]
    prose = [b.text for x in real for b, label in x if label and len(b.text) < 2000]
    layouts = Layouts(prose, seed)
    rows = [x for x in (*real, *(layouts.page() for _ in range(made))) if x]
    vectors = Vectors()
    data = [(vectors.page([b for b, _ in x]), np.array([y for _, y in x], np.float32)) for x in rows]
    model, state, draw = Labeller(seed), {}, np.random.default_rng(seed)
    for epoch in range(epochs):
        order = draw.permutation(len(data))
        order = sorted(order, key=lambda i: len(data[i][1]) // 8)  # alike in length, else at random
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for at in draw.permutation(len(batches)):
            chosen = [data[i] for i in batches[at]]
            model.step([x for x, _ in chosen], [y for _, y in chosen], state, RATE * (1 - epoch / epochs))
    return model


def fit(
    spark: SparkSession, pages: DataFrame, sample: int = SAMPLE, html_column: str = "html"
) -> Labeller:
    """Train on `sample` rows at most, chosen by a hash; without pages, on invented prose.

    Only hashes are sorted; whole pages reach the driver once the smallest hashes are known,
    one page of each.
    """
    page = F.col(common.plain(html_column))
    drawn = pages.where(page.isNotNull()).select(page.alias("html"), F.xxhash64(page).alias("at"))
    least = drawn.select("at").distinct().orderBy("at").limit(sample)
    last = least.agg(F.max("at")).first()[0]
    if last is None:
        return train([])
    rows = drawn.where(F.col("at") <= last).dropDuplicates(["at"]).limit(sample).collect()
    return train([r["html"] for r in sorted(rows, key=lambda r: r["at"])])


def extract(
    pages: DataFrame,
    model: Labeller,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """Per row: page_id, url, text (the blocks labelled as content, joined by a space), n_chars.

    Character references are decoded, white space inside a block becomes one space. NULL and
    empty pages have the empty text. Each row is labelled alone, so repeated rows get equal
    results. Other columns are not read.
    """
    common.small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(common.plain(id_column)).alias("page_id"),
        F.col(common.plain(url_column)).alias("url"),
        common.blob(F.col(common.plain(html_column))).alias("body"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in common.slices(batches, "body", 2_000_000):
            found = [blocks(x.as_py().decode()) for x in batch.column("body")]
            texts = main_texts(model, vectors, found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(
        labelled, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )


def main_texts(model: Labeller, vectors: Vectors, found: list[list[Block]]) -> list[str]:
    texts = [""] * len(found)
    order = sorted((i for i, x in enumerate(found) if x), key=lambda i: len(found[i]))
    while order:
        part = [order.pop(0)]
        while order and len(part) < 64 and len(found[order[0]]) <= len(found[part[0]]) * 1.2 + 2:
            part.append(order.pop(0))
        chosen = model.scores([vectors.page(found[i]) for i in part])
        for i, keep in zip(part, chosen, strict=True):
            texts[i] = " ".join(b.text for b, yes in zip(found[i], keep, strict=True) if yes)
    return texts
