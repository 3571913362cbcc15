"""Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

A word's features are itself and the character n-grams of "<word>", hashed to
buckets. A bag's hidden vector is the mean of its features' embeddings;
embeddings and softmax weights are trained jointly. As the output is linear in
the mean, a trained model folds to one row of class scores per bucket, and
scoring a text is a sum over its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np

from folio.llm.common import learned

BUCKETS = 1 << 16
DIM = 12
#: Shortest and longest character n-gram.
GRAMS = (3, 6)
#: Words whose rows a task remembers.
REMEMBERED = 400_000
#: Features that are held at once while words are scored, and while a step learns unless one bag has more.
BLOCK = 500_000


def grams(word: str) -> Iterator[int]:
    """Buckets of the word and of all its character n-grams, whatever its length."""
    w = f"<{word}>"
    yield zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
    for size in range(GRAMS[0], min(GRAMS[1], len(w)) + 1):
        for i in range(len(w) - size + 1):
            yield zlib.crc32(w[i : i + size].encode("utf-8", "replace")) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    w = f"<{word}>"
    found = [zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS]
    n = len(w)
    for size in range(GRAMS[0], min(GRAMS[1], n) + 1):
        found += [zlib.crc32(w[i : i + size].encode("utf-8", "replace")) % BUCKETS for i in range(n - size + 1)]
    return found


#: What a byte makes of CRC-32's register.
TABLE = np.array([zlib.crc32(bytes([k])) for k in range(256)], np.uint32) ^ np.uint32(0xFF000000)
TABLE ^= TABLE[0]


def after(crc: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Registers of CRC-32 after a character more, given by its code point, in UTF-8."""

    def fed(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return TABLE[(crc ^ byte) & 0xFF] ^ (crc >> 8)

    if points.max(initial=0) < 0x80:
        return fed(crc, points)
    p = points
    crc = fed(crc, np.where(p < 0x80, p, np.where(p < 0x800, 0xC0 | p >> 6, np.where(p < 0x10000, 0xE0 | p >> 12, 0xF0 | p >> 18))))
    for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
        more = np.flatnonzero(p >= least)
        crc[more] = fed(crc[more], 0x80 | (p[more] >> shift) & 0x3F)
    return crc


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What `features` gives for each of the words, in turn, and how many each has."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points >= 0xD800) & (points < 0xE000), np.uint32(ord("?")), points)
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    each = np.array([np.maximum(0, n - size + 1) for size in range(GRAMS[0], GRAMS[1] + 1)])
    counts = 1 + each.sum(0)
    base = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int64)
    flat[base] = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in marked), np.int64, len(marked))
    # the grams of one size of a word follow those of the size before
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(points))
    left = n[owner] + first[owner] - at
    put = base + 1
    crc = np.full(len(points), 0xFFFFFFFF, np.uint32)
    for size in range(1, GRAMS[1] + 1):
        fits = left[at] >= size
        at, crc = at[fits], crc[fits]
        crc = after(crc, points[at + size - 1])
        if size >= GRAMS[0]:
            flat[(put - first)[owner[at]] + at] = crc ^ np.uint32(0xFFFFFFFF)
            put = put + each[size - GRAMS[0]]
    return flat % BUCKETS, counts


class WordRows:
    """Rows of numbers for words, computed once for each distinct word."""

    def __init__(self, width: int, compute: Callable[[list[str]], np.ndarray], dtype=np.float32):
        self.compute, self.width, self.dtype = compute, width, dtype
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1 << 12, self.width), self.dtype)

    def look_up(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word of all lists in turn, words of each list)."""
        if len(self.number) > REMEMBERED:
            self.clear()
        counts = np.array([len(x) for x in lists], np.int64)
        known = self.number
        words = list(chain.from_iterable(lists))
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            late = [words[k] for k in missing.tolist()]
            new = list(dict.fromkeys(late))
            first = len(known)
            while first + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[first : first + len(new)] = self.compute(new)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            at[missing] = [known[w] for w in late]
        return self.table[at], counts


def kept_rows(name: str, make: Callable[[], WordRows]) -> WordRows:
    """The rows that this Python worker has computed for the model of that name, those of another model being forgotten."""
    kept = learned("word rows")
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def step_ends(sizes: np.ndarray, batch: int) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive steps of `batch` bags, cut further where bags of these sizes hold over BLOCK features."""
    for lo in range(0, len(sizes), batch):
        held = 0
        for k, n in enumerate(sizes[lo : lo + batch].tolist(), lo):
            if held and held + n > BLOCK:
                yield lo, k
                lo, held = k, 0
            held += n
        yield lo, k + 1


class Model:
    """Embeddings and softmax weights."""

    def __init__(self, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.w = np.zeros((DIM, classes), np.float32)
        self.b = np.zeros(classes, np.float32)

    def fit(self, bags: list[np.ndarray], targets: np.ndarray, weights: np.ndarray | None = None, epochs: int = 4, rate: float = 0.2, batch: int = 64, seed: int = 2) -> Model:
        """Stochastic gradient descent over the bags (arrays of buckets) with a falling rate; targets are class shares.

        Each embedding and the softmax divide their step by the root of their summed squared gradients (Duchi et al., 2011).
        """
        rng = np.random.default_rng(seed)
        sizes = np.array([len(x) for x in bags], np.int64)
        flat = np.concatenate(bags) if bags else np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        weights = np.ones(len(bags), np.float32) if weights is None else weights.astype(np.float32)
        seen_e, seen_w, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.float32(1e-8), np.float32(1e-8)
        each = -(-len(bags) // batch)
        steps = max(1, epochs * each)
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for lo, hi in step_ends(sizes[order], batch):
                mine = order[lo:hi]
                step = epoch * each + lo / batch
                n = sizes[mine]
                ids = flat[np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                mean = np.add.reduceat(self.e[ids], np.cumsum(n) - n, axis=0) / n[:, None]
                z = mean @ self.w + self.b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p -= targets[mine]
                p *= weights[mine][:, None]
                r = rate * (1 - step / steps)
                back = (p @ self.w.T).astype(np.float32) / n[:, None].astype(np.float32)
                gw, gb = mean.T @ p / len(mine), p.mean(0)
                seen_w += (gw * gw).mean()
                seen_b += (gb * gb).mean()
                self.w -= r * gw / np.sqrt(seen_w)
                self.b -= r * gb / np.sqrt(seen_b)
                put = np.argsort(ids, kind="stable")
                uniq, first = np.unique(ids[put], return_index=True)
                owner = np.repeat(np.arange(len(mine)), n)[put]
                g = np.add.reduceat(back[owner], first, axis=0)
                seen_e[uniq] += (g * g).mean(1)
                self.e[uniq] -= r * g / np.sqrt(seen_e[uniq])[:, None]
        return self

    def folded(self) -> np.ndarray:
        """Class scores of each bucket; a bag's scores are the mean of its buckets' plus the bias."""
        return self.e @ self.w


def word_scores(folded: np.ndarray) -> Callable[[list[str]], np.ndarray]:
    """For words: the sums of their features' class scores, and in the last column how many features."""

    def summed(words: list[str]) -> np.ndarray:
        flat, counts = features_of(words)
        return np.concatenate((np.add.reduceat(folded[flat], np.cumsum(counts) - counts, axis=0), counts[:, None]), axis=1)

    def long_word(word: str) -> np.ndarray:
        total, rest = np.zeros(folded.shape[1] + 1), grams(word)
        while len(part := np.fromiter(islice(rest, BLOCK), np.int64)):
            total[:-1] += folded[part].sum(0, dtype=np.float64)
            total[-1] += len(part)
        return total[None, :]

    def compute(words: list[str]) -> np.ndarray:
        each = GRAMS[1] - GRAMS[0] + 1
        out, lo, held = [], 0, 0
        for hi, w in enumerate(words):
            n = each * (len(w) + 2)
            if held and held + n > BLOCK:
                out.append(summed(words[lo:hi]))
                lo, held = hi, 0
            if n > BLOCK:
                out.append(long_word(w))
                lo = hi + 1
            else:
                held += n
        if held:
            out.append(summed(words[lo:]))
        return np.concatenate(out)

    return compute


def bag(words: Iterable[str], cache: dict[str, np.ndarray]) -> np.ndarray:
    """The features of all words."""
    out = []
    for w in words:
        f = cache.get(w)
        if f is None:
            f = cache[w] = np.array(features(w), np.int32)
        out.append(f)
    return np.concatenate(out) if out else np.zeros(0, np.int32)
