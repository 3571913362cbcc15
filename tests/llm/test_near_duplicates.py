import random

import numpy as np
import pytest
import xxhash

from folio.llm import simhash, vectors
from folio.llm.components import components


def roots_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 300, 1) if i % 50] + [(400, 400 + i) for i in range(1, 90)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components(links).collect()}
    want = roots_of(1000, pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: want[i] for i in nodes}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    texts = [None, "", " \t ", "One", "one two", "ONE  two\x0bthree", "one two three", "É é"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 60, 300]))]
        for _ in range(4):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(5)
    fps = [brute_fingerprint(t) for t in texts]
    want = roots_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}


@pytest.mark.parametrize("block", [2048, 40])
def test_fingerprint_links(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 60, np.uint64)
    centre[:40] = centre[0]
    near = [int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for c in centre for _ in range(6)]
    every = np.array(sorted(set(near)), np.uint64)
    i, j = np.nonzero(np.bitwise_count(every[:, None] ^ every[None, :]) <= 2)
    want = {(int(every[a]), int(every[b])) for a, b in zip(i, j, strict=True) if a < b}
    fps = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    rows = simhash.fingerprint_links(fps, 2, block, whole=True).collect()
    some = simhash.fingerprint_links(fps, 2, block).collect()
    number = {int(x): k for k, x in enumerate(every.view(np.int64))}
    assert roots_of(len(every), [(number[r.a], number[r.b]) for r in some]) == roots_of(len(every), [(number[r.a], number[r.b]) for r in rows]) and len(some) < len(rows)
    got = [tuple(sorted(int(np.int64(x).view(np.uint64)) for x in (r.a, r.b))) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("block", [1024, 30])
def test_vectors_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(vectors.class_links, "__defaults__", (0.98, 8, 2, block, 2048))
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        for _ in range(60):
            v = rng.normal(size=16)
            for _ in range(rng.integers(1, 4)):
                rows.append(((v + rng.normal(size=16) * rng.choice([0, 0.05, 0.08])).astype("f4").tolist(), label))
    rows += [(rows[0][0], 0)] * 20 + [([x * 2 for x in rows[0][0]], 0), (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0, None] * 8, 1), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e30] * 16, 0), ([1e-30] * 16, 0)]
    n = len(rows)
    table = spark.createDataFrame([(i, e, label, 7) for i, (e, label) in enumerate(rows)], "vec_id long, embedding array<float>, label int, usable int").repartition(3)
    ok = [label is not None and e and None not in e and np.isfinite(e).all() and any(e) for e, label in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][0]) == len(rows[j][0]):
                a, b = (np.array(np.float32(rows[k][0]), "f8") for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    pairs.append((i, j))
    want = roots_of(n, pairs)
    links = np.bincount(np.array(pairs).ravel(), minlength=n)
    got = {r.vec_id: r for r in vectors.near_duplicates(table).collect()}
    assert len(got) == n
    right = sum(got[i].n_links == links[i] and got[i].component_id == want[i] for i in range(n))
    assert right >= 0.97 * n
    assert all(got[i].n_links <= links[i] and got[i].kept == (got[i].component_id == i) for i in range(n))
