"""Suffix arrays of byte strings in numpy."""

from __future__ import annotations

import numpy as np

#: Lanes in which common prefixes are computed side by side.
LANES = 2_048


def words(data: bytes, order: str = ">") -> np.ndarray:
    """The eight bytes at every position as an integer; zero bytes follow the end."""
    padded = data + bytes(16)
    out = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded, f"{order}u8", (len(padded) - k) // 8, k)
        out[k::8] = part[: len(out[k::8])]
    return out[: len(data)]


def suffix_array(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their suffixes, and the rank of each position.

    Larsson-Sadakane refinement: begin with the order of the first eight bytes; as long as
    positions are equal, order each group of them by the rank of what follows the compared
    length, which doubles it. Groups of one are done and never looked at again. The order is
    complete: a partial one would not bear the step from one common prefix to the next.
    """
    n = len(data)
    first = words(data)
    sa = np.argsort(first)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = first[sa[1:]] != first[sa[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        at = sa[open_]
        group = rank[at]
        after = rank[np.minimum(at + h, n)] + 1
        # one key for both: a group's rank, then what follows
        both = group * (n + 1) + after
        order = np.argsort(both)
        at, both = at[order], both[order]
        sa[open_] = at
        cut = np.empty(len(at), bool)
        cut[:1] = True
        cut[1:] = both[1:] != both[:-1]
        rank[at] = open_[np.maximum.accumulate(np.where(cut, np.arange(len(at)), 0))]
        open_ = open_[~(cut & np.append(cut[1:], True))]
        h *= 2
    return sa, rank[:n]


def ranks_to_depth(tokens: np.ndarray, depth: int) -> np.ndarray:
    """For each position the rank of its suffix by the first `depth` tokens, a power of two; tokens count from 0.

    The same refinement, over whole tokens and no deeper than asked: each step orders pairs of ranks and doubles the
    compared length, so equal ranks in the end are equal runs of `depth` tokens. What lies beyond the end is least.
    """
    rank = np.asarray(tokens, np.int64)
    h = 1
    while h < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-h] = rank[h:] + 1
        both = rank * (int(rank.max(initial=0)) + 2) + after
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return rank


def common_prefixes(data: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of the suffix array the length of the prefix shared with the place before, up to `most`.

    Kasai's method: in the order of the text, a position shares at least one byte less with its predecessor than the
    position before it did, so only what lies beyond is compared. The text is cut into lanes that
    advance together; each begins anew.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    le = words(data + bytes(most + 8), "<")
    shared = np.zeros(n, np.int64)
    steps = -(-n // min(n, LANES)) if n else 0
    start = np.arange(0, n, steps) if steps else np.zeros(0, np.int64)
    h = np.zeros(len(start), np.int64)
    for t in range(steps):
        i = start + t
        live = np.flatnonzero((i < np.minimum(start + steps, n)))
        i = i[live]
        j = before[i]
        g = np.where(j < 0, 0, np.maximum(h[live] - 1, 0))
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            x = le[i[todo] + g[todo]] ^ le[j[todo] + g[todo]]
            # bytes that agree before the lowest differing one
            low = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            g[todo] += low
            todo = todo[(low == 8) & (g[todo] < most)]
        g = np.minimum(g, np.minimum(most, n - np.maximum(i, j)))
        shared[i] = g
        h[live] = g
    out = np.zeros(n, np.int64)
    out[1:] = shared[sa[1:]]
    return out
