import random

import numpy as np

from folio.llm import html_extract as h

BAR = "Subscribe to this very fine site for much more of the same every day"


def test_copies_on_one_host_keep_their_text(spark):
    own = "a text without any mark that is long enough to be searched for repeats"
    rows = [(i, f"http://h/{i}", f"<p>{own}</p><div>{BAR}</div>") for i in range(4)]
    rows += [(10, "http://h/10", f"<p>{'z' * 60}</p><div>{BAR}</div>"), (20, "http://k/1", f"<p>{own}</p>"), (21, "http://k/2", f"<p>{own}</p>")]
    got = {r.page_id: r.text for r in h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == own for i in (0, 1, 2, 3, 20, 21)) and got[10] == "z" * 60


def test_unique_words_of_a_covered_block_stay():
    words = f"{BAR} Zoë {BAR}".split()
    gone = np.array([w != "Zoë" for w in words])
    assert h.unique_runs(words, gone, 8) == ["Zoë"]
    assert h.unique_runs(BAR.split(), np.ones(15, bool), 8) == []
    # a few words that happen to recur at an edge are no boilerplate, a whole short block is
    assert h.unique_runs(["The", "one", "day"], np.array([True, False, False]), 8) == ["The", "one", "day"]
    assert h.unique_runs(["Advertisement"], np.array([True]), 8) == []


def streams(seed, pages):
    """Random blocks of a small vocabulary, with some that many pages have."""
    rng = random.Random(seed)
    said = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    common = [said(rng.randint(6, 14)) for _ in range(3)]
    out = []
    for p in range(pages):
        blocks = [(rng.choice([h.IN, h.OPEN, h.OUT]), said(rng.randint(1, 30))) for _ in range(rng.randint(0, 4))]
        for c in common:
            if rng.random() < 0.7:
                blocks.insert(rng.randint(0, len(blocks)), (rng.choice([h.IN, h.OPEN]), c))
        out.append(blocks)
    return out


def brute_repeated(pages, length):
    """Which words of each block recur, by comparing every window with every other; no page of these is a copy."""
    tokens = [[x for k, t in found for x in [("begin", k), *t.split(" ")]] for found in pages]
    kinds = [[k for k, t in found for _ in range(1 + len(t.split(" ")))] for found in pages]
    on = {}
    for p, stream in enumerate(tokens):
        for i in range(len(stream) - length + 1):
            on.setdefault(tuple(stream[i : i + length]), set()).add(p)
    out = []
    for stream, kind in zip(tokens, kinds, strict=True):
        gone = [False] * len(stream)
        for i in range(len(stream) - length + 1):
            n = len(on[tuple(stream[i : i + length])])
            for j in range(i, i + length):
                share, least = h.ENOUGH[kind[j]]
                gone[j] |= n >= max(least, share * len(pages))
        out.append(sum(g and isinstance(x, str) for g, x in zip(gone, stream, strict=True)))
    return out


def test_against_plain_search():
    some = 0
    for seed in range(30):
        pages = streams(seed, 12)
        got = h.texts_of(pages, 4)
        copies = [p for p, q in enumerate(pages) if len(q) < 2]
        want = brute_repeated(pages, 4)
        if not copies:
            assert [g[2] for g in got] == want
            some += 1
        assert [g[1] for g in got] == [sum(len(t.split(" ")) for _, t in p) for p in pages]
    assert some > 5


def test_shards_of_a_large_host(spark, monkeypatch):
    """A host in several shards gives what one shard gives, if what recurs does so everywhere."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    for i in range(120):
        own = " ".join(word() for _ in range(30))
        rows.append((i, "http://h/" + str(i), f"<div>{BAR}</div><div>{own}</div>"))
        want[i] = own
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (h.SHARD, 8_000):
        monkeypatch.setattr(h, "SHARD", size)
        got = {r.page_id: r.text for r in h.main_texts(pages).collect()}
        assert got == want


def test_articles_that_quote_each_other_stay_and_a_repeated_insert_goes(spark):
    quote = "it was said in the house on that day that nothing of the kind had been seen"
    rows = []
    for i in range(20):
        own = " ".join(f"w{i}x{k}" for k in range(40))
        rows.append((i, "http://h/" + str(i), f"<nav>menu {i}</nav><article><p>{own}</p><div>{BAR}</div><p>{quote if i < 10 else 'none here'} {i}</p></article>"))
    got = {r.page_id: r for r in h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        own = " ".join(f"w{i}x{k}" for k in range(40))
        assert got[i].text == f"{own} {quote if i < 10 else 'none here'} {i}"
        assert got[i].n_chars == len(got[i].text) and got[i].n_repeated == len(BAR.split())


def test_a_very_long_page(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "http://h/1", f"<article><p>{long}</p></article>"), (2, "http://h/2", f"<p>{long}"), (3, "http://h/3", "<p>" * 50_000 + "x")]
    got = {r.page_id: r.text for r in h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: long, 2: long, 3: "x"}
