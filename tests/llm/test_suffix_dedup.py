import hashlib
import random

import numpy as np
import pytest

from folio.llm import exact_repeats, suffix_array, suffix_dedup


@pytest.mark.parametrize("data", [b"", b"a", b"banana" * 9, b"\0" * 70 + b"ab\0" * 20, bytes(random.Random(1).choices(b"ab", k=3000)), b"abcdefgh" * 700, b"x" * 300 + b"y" + b"x" * 299 + b"z" + b"x" * 290])
def test_suffix_array(data):
    n, depth = len(data), 40
    sa, rank = suffix_array.suffix_array(data)
    assert sa.tolist() == sorted(range(n), key=lambda i: data[i:]) and rank[sa].tolist() == list(range(n))
    cut = [data[i : i + depth] for i in sa.tolist()]
    lcp = suffix_array.common_prefixes(data, sa, depth)
    for k in range(1, n):
        a, b = cut[k - 1], cut[k]
        m = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == m


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            seen.setdefault(d[p : p + length], []).append((i, p))
    gone = [set() for _ in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + length))
    out = []
    for d, g in zip(data, gone, strict=True):
        spans = sum(p in g and p - 1 not in g for p in range(len(d)))
        out.append((len(d), len(g), spans, hashlib.sha256(bytes(c for p, c in enumerate(d) if p not in g)).hexdigest()))
    return out


def texts(seed, length):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    shared = [part(rng.choice([length - 3, length, length + 1, length + 40, 3 * length])) for _ in range(6)]
    out = [None, "", "x", "ab" * length, "z" * (length + 5), "q" * (length - 1), part(20_000)]
    for _ in range(60):
        t = part(rng.randint(0, 2 * length))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(shared) + part(rng.choice([0, 1, 50, length]))
        out.append(t)
    copy = list(out[20])
    copy[len(copy) // 2 : len(copy) // 2 + 1] = "!"
    return [*out, "".join(copy), out[21], out[21]]


@pytest.mark.parametrize(("length", "cut", "shard"), [(200, 2 << 20, 512 << 10), (40, 2 << 20, 512 << 10), (64, 3000, 2000)])
def test_against_brute_force(spark, monkeypatch, length, cut, shard):
    monkeypatch.setattr(exact_repeats, "CUT", cut)
    monkeypatch.setattr(exact_repeats, "SHARD", shard)
    monkeypatch.setattr(exact_repeats, "MERGE", 5000)
    every = texts(length, length)
    want = brute(every, length)
    rows = [(i, t, "b") for i, t in enumerate(every)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removals(docs, length).collect()}
    assert [got[i] for i in range(len(every))] == want


def test_repeated_rows_and_nulls(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(300))
    docs = spark.createDataFrame([(1, t), (1, t), (None, "a" * 150), (2, "B" + t[:199])], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in suffix_dedup.removals(docs).collect())
    assert got == [(0, 0), (1, 300), (1, 300), (2, 0)]
    assert suffix_dedup.removals(docs.limit(0)).count() == 0
    left = suffix_dedup.cleaned(docs.withColumn("runs", docs.doc_id)).collect()
    assert sorted(len(r.text) for r in left) == [0, 0, 150, 200]


def test_least_of_each_run():
    assert np.all(exact_repeats.least_of(np.array([3, 1, 2, 5, 4]), 3) == [1, 1, 2])
