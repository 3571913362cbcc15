"""A host's pages give the same texts however it is cut into shards."""

import random

from folio.llm import html_extract as h


def pages_of_hosts(seed, n):
    """Unmarked and marked pages of two hosts: a rare bar, a frequent one, quotations, copies and near copies of pages in other shards."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rare, common, quotes = words(20), words(15), [words(12) for _ in range(8)]
    rows, texts = [], []
    for i in range(n):
        blocks = [words(30)]
        if i and rng.random() < 0.3:  # like an earlier page, exactly or but for a few words
            blocks = rng.choice(texts).split("|")
            blocks = [b + (" " + words(1) if rng.random() < 0.4 else "") for b in blocks]
        else:
            blocks += [rare] * (rng.random() < 0.12) + [common] * (rng.random() < 0.85) + [rng.choice(quotes)] * (rng.random() < 0.5)
        texts.append("|".join(blocks))
        body = "".join(f"<div>{b}</div>" for b in blocks)
        page = f"<nav>{quotes[0]} menu {i % 3}</nav>" + (f"<article>{body}</article>" if i % 4 == 0 else body)
        rows.append((i, f"http://{'h' if i % 3 else 'k'}/{i}", page))
    return rows + [(n, "http://h/none", None), (n + 1, "http://h/empty", ""), (n + 2, "http://h/short", "<p>a b")] + rows[:4] + [rows[5]] * 3


def test_texts_do_not_depend_on_shards(spark, monkeypatch):
    for seed in (1, 2):
        pages = spark.createDataFrame(pages_of_hosts(seed, 160), "page_id long, url string, html string").repartition(3)
        got = {}
        for size in (h.SHARD, 15_000, 3_000):
            monkeypatch.setattr(h, "SHARD", size)
            got[size] = sorted(map(tuple, h.main_texts(pages).collect()), key=str)
        assert len(got[3_000]) == 170
        assert got[3_000] == got[15_000] == next(iter(got.values()))
        assert sum(r[5] for r in got[3_000]) > 1000


def test_a_rare_bar_goes_from_all_pages_of_a_sharded_host(spark, monkeypatch):
    bar = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rng = random.Random(5)
    own = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)) for _ in range(120)]
    rows = [(i, f"http://h/{i}", f"<div>{own[i]}</div>" + (f"<div>{bar}</div>" if i % 8 == 0 else "")) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (h.SHARD, 8_000, 2_000):
        monkeypatch.setattr(h, "SHARD", size)
        assert {r.page_id: r.text for r in h.main_texts(pages).collect()} == dict(enumerate(own))
