"""Byte-level BPE encoding and decoding by a trie of distinct words.

BPE splits a text into words first and never merges across them. For a prefix of a word, the
last token of its encoding settles the rest: what stands before that token is a shorter prefix.
So the distinct words of a batch are put in a trie and walked depth first; every node, that is
every shared prefix, gets its last token once, and a word's encoding is read backwards from its
node. Sorted words are the trie in depth-first order, so the path to the current word is all
that is held.

The last token of a prefix is the token t ending there that can follow the last token of what
stands before t: joining the two would leave both whole. That holds for one token only.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermart.llm import common

#: How byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encodings a worker remembers, and pairs of tokens whose fit it remembers.
WORDS, PAIRS = 400_000, 500_000
#: Bytes of text whose words are put in one trie.
PART = 1_000_000
_NEVER = 1 << 60


def encode(
    docs: DataFrame,
    vocabulary: str,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    `vocabulary` is the path, on every executor, of a byte-level BPE file in the format of the
    tokenizers library. Special tokens in a text become their ids. ids_sha256 is the digest of
    the decimal ids joined by commas, decoded_sha256 that of the text decoded from them. NULL
    is the empty text and has no tokens. Each row is encoded alone, so repeated rows get equal
    results. Other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(
        F.col(common.plain(id_column)).alias("doc_id"),
        common.blob(F.col(common.plain(text_column))).alias("body"),
    )
    identity = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {identity}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"
    return texts.mapInArrow(lambda b: _encoded(b, vocabulary, with_ids), schema)


def _encoded(
    batches: Iterator[pa.RecordBatch], vocabulary: str, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary)
    for batch in common.slices(batches, "body", PART):
        out = [
            (
                sum(x[1] for x in parts),
                hashlib.sha256(",".join([x[0] for x in parts]).encode()).hexdigest(),
                hashlib.sha256(decoded(b"".join([x[2] for x in parts]))).hexdigest(),
                ",".join([x[0] for x in parts]) if with_ids else None,
            )
            for parts in coder.encode([x.as_py().decode() for x in batch.column("body")])
        ]
        n_tokens, ids_sha, text_sha, ids = zip(*out, strict=True)
        columns = [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            offsets = np.r_[0, np.cumsum(n_tokens)].astype(np.int32)
            flat = np.array(",".join([x for x in ids if x]).split(",") if offsets[-1] else [], np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def decoded(raw: bytes) -> bytes:
    """What decoding yields for the bytes of the tokens; stray bytes become U+FFFD."""
    return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def _coder(vocabulary: str) -> Coder:
    return Coder(vocabulary)


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else
    the next of the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """The vocabulary and what was learned about words so far; both caches are bounded."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        split = spec.get("pre_tokenizer") or {}
        odd = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level vocabularies are read")
        if any(model.get(x) for x in odd) or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE models are read")
        added = spec.get("added_tokens") or []
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens must be matched as they stand")
        self.special = {x["content"]: x["id"] for x in added}
        known = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(known) + ")") if known else None
        self.words = regex.compile(PATTERN)
        self.ids = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y = model["vocab"][a], model["vocab"][b]
            made = model["vocab"][a + b]
            if any(p in parts and parts[p][2] > rank for p in (x, y)):
                raise ValueError("a merge must come after those of its parts")
            self.merge[x, y] = (rank, made)
            parts.setdefault(made, (x, y, rank))
        self.parts = parts
        self.bytes = {i: t for t, i in self.ids.items()}
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.standing = {t: i for t, i in self.ids.items() if self._stands(i)}
        self.longest = max(map(len, self.standing))

    def encode(self, texts: Iterable[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text its words in order, as (ids joined by commas, how many, their bytes)."""
        cut = [self._words(x) for x in texts]
        fresh = {w for words in cut for w in words} - self.known.keys()
        if len(self.known) + len(fresh) > WORDS:
            self.known.clear()
            fresh = {w for words in cut for w in words}
        if fresh:
            self._learn(fresh)
        known = self.known
        for words in cut:
            yield [known[w] for w in words]

    def _words(self, text: str) -> list[str]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.words.findall(text)
        out = []
        for piece in self.cut.split(text):
            out.extend([piece] if piece in self.special else self.words.findall(piece))
        return out

    def _learn(self, fresh: set[str]) -> None:
        for word in [w for w in fresh if w in self.special]:
            fresh.discard(word)
            self.known[word] = (str(self.special[word]), 1, word.encode())
        standing, fits, longest = self.standing.get, self.fits.get, self.longest
        before, last = b"", [-1]  # last: the last token of each prefix of the word before
        for raw, word in sorted((w.encode(), w) for w in fresh):
            shared = min(len(before), len(raw))
            while before[:shared] != raw[:shared]:
                shared -= 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = standing(raw[start:end])
                    if token is not None:
                        if not start:
                            break
                        fit = fits(last[start] << 20 | token)
                        if fit or fit is None and self._fit(last[start], token):
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
            before = raw
            tokens, end = [], len(raw)
            while end:
                tokens.append(last[end])
                end -= len(self.bytes[last[end]])
            tokens.reverse()
            self.known[word] = (
                ",".join(map(str, tokens)),
                len(tokens),
                b"".join([self.bytes[t] for t in tokens]),
            )

    def _stands(self, token: int) -> bool:
        """Encoding the token's own bytes gives the token back."""
        found = self.whole.get(token)
        if found is None:
            part = self.parts.get(token)
            found = self.whole[token] = part is None or (
                self._stands(part[0])
                and self._stands(part[1])
                and self._fit(part[0], part[1], below=part[2])
            )
        return found

    def _fit(self, a: int, b: int, below: int = _NEVER) -> bool:
        """No merge across the border of a and b happens before both are complete.

        Merges run by rank. At the border stand pieces of a and b that grow as their own merges
        come up; a merge of the two pieces takes place if its rank is smaller than that of the
        next own merge of a's piece and not larger than that of b's (of equal ones the leftmost
        is first). With `below`, merges from that rank on do not count.
        """
        key = a << 20 | b
        if below == _NEVER and (found := self.fits.get(key)) is not None:
            return found
        x, y = self._spine(a, self.right, 1), self._spine(b, self.left, 0)
        i = j = 0
        fit = True
        while True:
            (p, p_next), (q, q_next) = x[i], y[j]
            across = self.merge.get((p, q))
            if across and across[0] < p_next and across[0] <= q_next and across[0] < below:
                fit = False
                break
            if p_next == q_next == _NEVER:
                break
            if p_next <= q_next:
                i += 1
            else:
                j += 1
        if below == _NEVER:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = fit
        return fit

    def _spine(self, token: int, known: dict[int, list], side: int) -> list[tuple[int, int]]:
        """Pieces of a token at its right (1) or left (0) end, the smallest first, each with
        the rank of the merge that makes the next."""
        spine = known.get(token)
        if spine is None:
            spine, at, grows = [], token, _NEVER
            while True:
                spine.append((at, grows))
                part = self.parts.get(at)
                if part is None:
                    break
                at, grows = part[side], part[2]
            spine.reverse()
            known[token] = spine
        return spine
