"""Removed word sequences against a dictionary of all windows; anchors of equal windows."""

import hashlib
import random

import numpy as np
import pytest

from folio.llm import phrase_dedup, recompression
from folio.llm.recompression import END, Words, anchors


def brute(rows, window):
    data = [(phrase_dedup.BEFORE_ALL if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for d, w in data:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, (d, p)), (d, p))
    out = []
    for (i, _), (d, w) in zip(rows, data, strict=True):
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < (d, p) for q in range(p, p + window)}
        left = [x for q, x in enumerate(w) if q not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, window, vocabulary):
    rng = random.Random(seed)
    word = lambda: rng.choice(vocabulary)
    part = lambda n: [word() for _ in range(n)]
    shared = [part(rng.choice([window - 1, window, window + 1, 2 * window, 5 * window])) for _ in range(8)]
    out = [[], ["x"], ["la"] * (3 * window), ["a", "b"] * (2 * window), ["a", "b", "c"] * window, part(3000)]
    for _ in range(70):
        t = part(rng.randint(0, 2 * window))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(shared) + part(rng.choice([0, 1, 3, window]))
        out.append(t)
    near = list(out[5])
    near[1500] = "other"
    spaced = ["".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in t) for t in [*out, near, out[30], out[30]]]
    return [(i if i % 9 else None, t) for i, t in enumerate(spaced)] + [(7, None), (8, ""), (20, spaced[20]), (20, spaced[20]), (20, spaced[21] + " y")]


WIDE = [f"w{k}" for k in range(400)]


@pytest.mark.parametrize(("window", "vocabulary", "buffer", "part"), [(20, WIDE, 1_500_000, 100_000), (20, ["a", "b", "é"], 3000, 50), (6, WIDE[:5], 500, 9), (3, WIDE, 2000, 100)])
def test_against_all_windows(spark, monkeypatch, window, vocabulary, buffer, part):
    monkeypatch.setattr(phrase_dedup, "BUFFER", buffer)
    monkeypatch.setattr(phrase_dedup, "PART", part)
    rows = texts(window, window, vocabulary)
    got = phrase_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window)
    want = brute(rows, window)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(w[2] > 0 for w in want) > 30


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_anchors(seed):
    rng = np.random.default_rng(seed)
    kinds = [2, 3, 5, 50, 1000, 2][seed]
    base = rng.integers(0, kinds, 4000)
    words = np.concatenate((base, base[1000:1400], rng.integers(0, kinds, 300), base[1010:1200], np.zeros(100, int), base[5:60]))
    data = " ".join(f"w{k}" for k in words).encode().split()
    data[2000:2000] = [END]
    w = Words(b" ".join([*data, END]))
    start, name, place = anchors(w, 20)
    seen = {}
    for s, n, p in zip(start.tolist(), name.tolist(), place.tolist(), strict=True):
        assert seen.setdefault(tuple(data[s : s + 20]), (n, p - s)) == (n, p - s) and s <= p < s + 20
        assert END not in data[s : s + 20]
    assert len(start) == len(data) - 1 - 2 * 19


def test_levels_get_shorter():
    w = Words(b" ".join(f"w{k * k % 977}".encode() for k in range(5000)) + b" " + END)
    sizes = [len(x.name) for x in recompression.levels(w)]
    assert all(b < 0.85 * a for a, b in zip(sizes, sizes[1:], strict=False))
    runs = recompression.levels(Words(b" ".join([b"la"] * 1000 + [END])), 1)[1]
    assert len(runs.name) == 2


def test_cleaned_keeps_columns_and_long_words(spark):
    long = "x" * 10_000
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(1, f"{long} {passage}  end", "en"), (2, f"start {passage} {long}y", None), (3, f"{long}z {passage}", "en"), (4, None, "x"), (5, "two  spaces", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *[f"'c' as {c}" for c in ("name", "d1", "body", "runs", "start", "kept")])
    got = {r.doc_id: r for r in phrase_dedup.cleaned(frame).collect()}
    assert got[1].text == rows[0][1] and got[2].text == f"start {long}y" and got[3].text == f"{long}z" and got[4].text is None and got[5].text == "two  spaces"
    assert got[2].lang is None and got[2].runs == "c" and phrase_dedup.cleaned(frame).columns == frame.columns
    assert phrase_dedup.removals(frame.limit(0)).collect() == []
