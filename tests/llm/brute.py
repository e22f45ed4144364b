"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(seed: int, count: int) -> str:
    draw = random.Random(seed)
    letters = "etaoinshrdlucmfw"
    made = ("".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(count))
    return " ".join(made)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def removed(rows: list[tuple], size: int = 35) -> list[tuple]:
    lists = [(i, words(t)) for i, t in rows]
    seen = collections.Counter(
        tuple(w[k : k + size]) for _, w in lists for k in range(len(w) - size + 1)
    )
    out = []
    for i, w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), sha(" ".join(kept))))
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def near(rows: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) for rows with distinct ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        root = find(k)
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return [
        (i, len(x), least.get(find(k)), i is not None and i == least.get(find(k)))
        for k, (i, x) in enumerate(sets)
    ]


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            again.update(range(k, k + 8))
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), failed


def exact(rows: list[tuple]) -> list[tuple]:
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for normal, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), stays and i == keep, sha(normal)))
            stays = False
    return out


def order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


def merkle(rows: list[tuple], found: dict[int, str | None] | None = None, fan: int = 16) -> list[tuple]:
    """Proofs of (doc_id, source, lang, n_chars, text) rows; `found` has other texts by doc_id."""

    def leaf(values):
        parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
        return sha("".join(parts))

    def grown(nodes):
        """The levels of a tree, the leaves first."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[k : k + fan])) for k in range(0, len(last), fan)])
        return levels

    def siblings(levels, at):
        for nodes in levels[:-1]:
            first = at // fan * fan
            yield nodes[first:at], nodes[at + 1 : first + fan]
            at //= fan

    found = found or {}
    trees = collections.defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    made = {s: grown([leaf(r) for r in held[s]]) for s in names}
    top = grown([made[s][-1][0] for s in names]) if names else None
    out = []
    for k, s in enumerate(names):
        for at, row in enumerate(held[s]):
            steps = [*siblings(made[s], at), *siblings(top, k)]
            value = leaf((*row[:4], found.get(row[0], row[4])))
            for left, right in steps:
                value = sha("".join((*left, value, *right)))
            proof = sha("".join(x for left, right in steps for x in (*left, *right)))
            root = top[-1][0]
            out.append((row[0], made[s][0][at], made[s][-1][0], root, proof, value, value == root))
    return out


def negatives(rows: list[tuple], every: int = 100, n_positives: int = 5, n_negatives: int = 10) -> list[tuple]:
    """Hard negatives of (vec_id, label, vector) rows whose id is divisible by `every`."""
    sound = [
        (i, c, [math.floor(256 * x) for x in v])
        for i, c, v in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, label, v) in enumerate(sound):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, c) for k, (i, c, w) in enumerate(sound) if k != a]  # noqa: B905
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:n_positives]:
            window = sorted(s for s in scored if s[2] != label and -30 * score <= -100 * s[0] <= -90 * score)
            out += [
                (anchor, positive, rank, i, -score, -other)
                for rank, (other, i, _) in enumerate(window[:n_negatives], 1)
            ]
    return out


def shared_subsequences(a: str, b: str, decay: float, gap: int, size: int = 3) -> float:
    """Kernel of two words: their common subsequences with gaps, weighted by spans."""

    def weights(word):
        out = collections.Counter()
        for places in itertools.combinations(range(len(word)), size):
            if max(q - p for p, q in itertools.pairwise(places)) <= gap:
                out["".join(word[p] for p in places)] += decay ** (places[-1] - places[0])
        return out

    x, y = weights(a), weights(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / norm
