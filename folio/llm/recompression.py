"""Recompression of word sequences: symbols that equal passages share.

Words are symbols of the first level. A round replaces every maximal run of a symbol, then
every pair of a left and a right symbol, by a symbol of the next level; which symbols are left
and which are right is drawn anew each round, from their names. A name is derived from what it
stands for, so every task gives the same run or pair the same name, and equal passages get
equal symbols but near their edges.

How near, is kept with each symbol: the words [low, high) that have decided it. A symbol whose
deciding words lie in a window stands at the same place of every equal window. It is that window's anchor if it is the best
of the highest level that has any. So equal windows have equal anchors, at equal places. Names are
64 bits and only propose: what shares an anchor is compared by its words.
"""

from __future__ import annotations

import numpy as np

#: Rounds after which phrases have some four words on average.
ROUNDS = 5
#: Longer words, in bytes, are replaced by their fingerprints.
LONG_WORD = 4096
#: Where a text ends; no byte of UTF-8.
END = b"\xff"
FAR = np.int64(1) << 40

ODD = np.uint64(0x9E3779B97F4A7C15)
FIRST, SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * FIRST
    x = (x ^ x >> np.uint64(27)) * SECOND
    return x ^ x >> np.uint64(31)


POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(POWERS.get("up", ())) < n:
        for name, base in (("up", int(ODD)), ("down", pow(int(ODD), -1, 1 << 64))):
            table = np.full(n, np.uint64(base))
            table[0] = 1
            POWERS[name] = np.cumprod(table)
    return POWERS["up"], POWERS["down"]


class Words:
    """Words that stand in a buffer between single spaces: where each begins and ends, and its name."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(raw == 32)
        self.data = data
        self.first, self.last = np.append(0, space + 1), np.append(space, len(raw))
        up, down = powers(len(raw) + 1)
        sums = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)]))
        self.name = mixed((sums[self.last] - sums[self.first]) * down[self.first])
        self.ends = np.flatnonzero(raw[self.first] == END[0])  # words that end a text
        self.name[self.ends] = mixed(self.ends.astype(np.uint64) * ODD)


class Level:
    """Symbols in order: name, first word, deciding words [low, high)."""

    def __init__(self, name: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, end: np.ndarray):
        self.name, self.start, self.low, self.high, self.end = name, start, low, high, end


def with_runs(x: Level, words: np.ndarray, total: int, salt: int) -> Level:
    """Every maximal run of a symbol becomes one.

    That a symbol's neighbour is another one is decided by the neighbour's nearest word
    if that differs from its own there, else by all that has decided the neighbour.
    """
    n = len(x.name)
    first = np.flatnonzero(np.append(True, x.name[1:] != x.name[:-1]))
    last = np.append(first[1:], n) - 1
    size = last - first
    name = x.name[first]
    long = size > 0
    name[long] = mixed(name[long] * ODD + size[long].astype(np.uint64) + np.uint64(salt))
    start, stop = x.start[first], np.append(x.start, total)[last + 1]
    low, high = np.minimum.reduceat(x.low, first), np.maximum.reduceat(x.high, first)
    # to the left
    there = start > 0
    low = np.where(there, np.minimum(low, start - 1), -FAR)
    alike = np.flatnonzero(there & (words[np.maximum(start - 1, 0)] == words[np.append(x.start, total)[first + 1] - 1]))
    before = first[alike] - 1
    low[alike], high[alike] = np.minimum(low[alike], x.low[before]), np.maximum(high[alike], x.high[before])
    # and to the right
    there = stop < total
    high = np.where(there, np.maximum(high, stop + 1), FAR)
    alike = np.flatnonzero(there & (words[np.minimum(stop, total - 1)] == words[x.start[last]]))
    after = last[alike] + 1
    low[alike], high[alike] = np.minimum(low[alike], x.low[after]), np.maximum(high[alike], x.high[after])
    return Level(name, start, low, high, x.end[first])


def with_pairs(x: Level, salt: int) -> Level:
    """Every left symbol becomes one with the right symbol that follows; where a text ends, nothing does."""
    n = len(x.name)
    right = (mixed(x.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    pair = np.append(~right[:-1] & right[1:] & ~x.end[:-1] & ~x.end[1:], False)
    second = np.append(False, pair[:-1])
    name, low, high = x.name.copy(), x.low.copy(), x.high.copy()
    p = np.flatnonzero(pair)
    name[p] = mixed(mixed(x.name[p] + np.uint64(salt)) * ODD + x.name[p + 1])
    low[p], high[p] = np.minimum(x.low[p], x.low[p + 1]), np.maximum(x.high[p], x.high[p + 1])
    # a right symbol stays alone for want of a left one before it, a left symbol for want of a right one behind it
    lone = ~pair & ~second
    for at, step in ((np.flatnonzero(lone & right), -1), (np.flatnonzero(lone & ~right), 1)):
        other = at + step
        known = (other >= 0) & (other < n)
        low[at[~known]], high[at[~known]] = -FAR, FAR
        at, other = at[known], other[known]
        low[at], high[at] = np.minimum(low[at], x.low[other]), np.maximum(high[at], x.high[other])
    keep = ~second
    return Level(name[keep], x.start[keep], low[keep], high[keep], x.end[keep])


def levels(words: Words, rounds: int = ROUNDS) -> list[Level]:
    """The levels of a buffer, the words first."""
    n = len(words.name)
    at = np.arange(n)
    end = np.zeros(n, bool)
    end[words.ends] = True
    now = Level(words.name, at, np.where(end, -FAR, at), np.where(end, FAR, at + 1), end)
    out = [now]
    for k in range(rounds):
        salt = (2 * k + 1) * 0x9E3779B9
        now = with_pairs(with_runs(now, words.name, n, salt), salt + 1)
        out.append(now)
    return out


def best_of(score: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range [lo, hi), not empty, the first place of its highest score."""
    size = hi - lo
    table = np.arange(len(score))
    out = np.empty(len(lo), np.int64)
    step = 1
    while len(lo) and step <= size.max():
        mine = np.flatnonzero((size >= step) & (size < 2 * step))
        a, b = table[lo[mine]], table[hi[mine] - step]
        out[mine] = np.where(score[a] >= score[b], a, b)
        if len(table) <= step:
            break
        a, b = table[:-step], table[step:]
        table = np.where(score[a] >= score[b], a, b)
        step *= 2
    return out


def anchors(words: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `window` words inside a text: its first word, the name of its anchor and the anchor's first word.

    The name is that of the symbol and of the words that have decided it.
    """
    n = len(words.name)
    mark = np.zeros(n + 1, np.int64)
    mark[words.ends + 1] = 1
    ended = np.cumsum(mark)
    start = np.arange(max(0, n - window + 1))
    start = start[ended[start + window] == ended[start]]
    name, place = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    open_ = np.arange(len(start))
    up, down = powers(n + 1)
    sums = np.append(np.uint64(0), np.cumsum(words.name * up[:n]))
    for k, x in reversed(list(enumerate(levels(words, rounds)))):
        fit = np.flatnonzero(x.high - x.low <= window)
        # neither bound ever decreases from one symbol to the next, so the symbols of a window are a range
        low, high = x.low[fit], x.high[fit]
        lo = np.searchsorted(low, start[open_], "left")
        hi = np.searchsorted(high, start[open_] + window, "right")
        some = lo < hi
        at = open_[some]
        best = fit[best_of(mixed(x.name[fit] ^ ODD), lo[some], hi[some])]
        inside = (sums[x.high[best]] - sums[x.low[best]]) * down[x.low[best]]
        name[at] = mixed(mixed(x.name[best] + np.uint64(k)) * ODD + inside)
        place[at] = x.start[best]
        open_ = open_[~some]
        if not len(open_):
            break
    return start, name, place
