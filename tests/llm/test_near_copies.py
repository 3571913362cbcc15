import os
import random

import numpy as np
import pytest

import corpus_pipeline
from folio.llm import near_copies
from tests.llm.test_near_duplicates import brute_fingerprint, roots_of


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return (not a and not b) or 5 * len(a & b) >= 4 * len(a | b)


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    line = " ".join(word() for _ in range(30))
    out = [None, "", " \t ", "One", "one", "one two", "ONE  two", "one two three four five", "One two three four five six"]
    for _ in range(30):
        base = [word() for _ in range(rng.choice([9, 13, 60, 300]))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 9])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = [line, *copy]
            out.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for k in range(12):  # each links with the next ones only
        out.append(" ".join([*chain[5 * k :], *[f"{k}{w}" for w in chain[: 5 * k]]]))
    return out


@pytest.mark.parametrize("few", [32, 2])
def test_against_brute_force_jaccard(spark, monkeypatch, few):
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "BLOCK", 512 if few > 2 else 3)
    monkeypatch.setattr(near_copies, "COLUMNS", 4096 if few > 2 else 50)
    rows = texts()
    sets = [shingles(t) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    want = roots_of(len(rows), pairs)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, id string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == dict(enumerate(want))
    # links that two differing bits of 3-word fingerprints never make
    assert sum((brute_fingerprint(rows[i]) ^ brute_fingerprint(rows[j])).bit_count() > 2 for i, j in pairs) > 30
    keep = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r.doc_id for r in keep(spark, docs, "").collect()) == sorted(set(want))


def test_empty(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_never_part_similar_sets():
    rng = np.random.default_rng(1)
    parted = 0
    for n in (1, 2, 60, 64, 65, 200, 700, 5000):
        for _ in range(40):
            one = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            two = np.unique(np.concatenate((one[rng.random(len(one)) < rng.choice([0.3, 0.7, 0.85, 0.9, 0.95, 1])], rng.integers(0, 1 << 63, int(rng.choice([0, 0.05, 0.2]) * n), np.uint64))))
            shared = len(np.intersect1d(one, two))
            like = len(two) and shared >= 0.8 * (len(one) + len(two) - shared)
            may = near_copies.could_agree(near_copies.bitmap(one), near_copies.bitmap(two), len(one), len(two), 0.8)
            assert may or not like
            parted += not may
    assert parted > 80


def test_bitmaps_at_once_are_as_one_by_one():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 63, 64, 65, 120, 128, 129, 200, 500)]
    sets += [np.unique(np.concatenate((h[: -(len(h) // 9) or None], rng.integers(0, 1 << 63, len(h) // 9, np.uint64)))) for h in sets]
    bits, n = [near_copies.bitmap(h) for h in sets], np.array([len(h) for h in sets], np.int32)
    i, j = np.triu_indices(len(sets), 1)
    want = [near_copies.could_agree(bits[a], bits[b], len(sets[a]), len(sets[b]), 0.8) for a, b in zip(i, j, strict=True)]
    assert near_copies.could_agree_each(bits, n, i, j, 0.8).tolist() == want and any(want) and not all(want)


def family(texts, words):
    """Texts that begin with the same words, and else have their own."""
    rng = random.Random(5)
    same = [f"s{k}" for k in range(words)]
    return [(i, " ".join([*same, *[f"w{rng.randrange(10**6)}" for _ in range(100 - words)]])) for i in range(texts)]


def test_whole_sets_go_only_where_bitmaps_leave_a_pair(spark, monkeypatch):
    """Texts that share a passage, but too little to link, are not copied to the blocks of each of its shingles."""
    rows = family(60, 60) + [(100, "a b c d e f g h"), (101, "a b c d e f g h")]
    rows += [(200 + i, " ".join([*[f"v{k}" for k in range(90)], *[f"x{i}_{k}" for k in range(10)]])) for i in range(8)]
    asked = []
    whole = near_copies.whole_sets
    monkeypatch.setattr(near_copies, "whole_sets", lambda ids, *rest: asked.append([r[0] for r in ids.collect()]) or whole(ids, *rest))
    monkeypatch.setattr(near_copies, "SAMPLE", 0)  # no shingle is known as common, as if the table were far larger than the sample
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    want = roots_of(len(ids), [(x, y) for x in range(len(ids)) for y in range(x) if similar(sets[ids[x]], sets[ids[y]])])
    assert got == {i: ids[r] for i, r in zip(ids, want, strict=True)}
    assert len(set(asked[-1])) <= 8


def test_little_is_left_on_disk(spark, monkeypatch):
    """Shuffle files go with each step, and the prefixes and places of the shingles before the groups are returned."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, stored = spark.conf.get(name, None), []
    staged = near_copies.staged
    monkeypatch.setattr(near_copies, "staged", lambda df, tag: stored.append((tag, spark.conf.get(name, None), staged(df, tag))) or stored[-1][2])
    assert near_copies.near_copies(spark.createDataFrame(family(30, 90), "doc_id long, text string")).count() == 30
    assert {x[1] for x in stored} == {"true"} and spark.conf.get(name, None) == before
    left = {tag for tag, _, df in stored if os.path.exists(df.staged_at.removeprefix("file://"))}
    assert not left & {"prefixes", "kinds", "held", "first", "near", "sets", "rest", "more"} and "members" in left
