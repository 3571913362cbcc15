"""What the shards of a host store and tell each other is small against their pages."""

import random
from pathlib import Path

import numpy as np

from folio.llm import html_extract as h

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_numbers_come_back_from_their_pack():
    rng = np.random.default_rng(1)
    for numbers in ([], [0], [-5, 7, -(2**62), 2**62], np.sort(rng.integers(0, 2**40, 1000)), rng.integers(-9, 9, 500)):
        assert h.unpacked(h.packed(np.array(numbers, np.int64))).tolist() == list(numbers)
    assert len(h.packed(np.arange(100_000))) < 8_000  # a hundredth of their bytes


def test_shards_store_less_than_their_pages(spark, monkeypatch, tmp_path):
    """Windows that hardly recur: their hashes alone would be larger than the pages as Parquet compresses them."""
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(40)]
    pages = [(i, f"http://h/{i}", "<p>" + " ".join(rng.choices(known, k=2_000))) for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / "pages"))
    read = sum(f.stat().st_size for f in (tmp_path / "pages").glob("*.parquet"))
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(h, "SHARD", 200_000)
    monkeypatch.setattr(h, "shared_dir", lambda _: str(tmp_path / "shared"))
    before = spark.conf.get(CLEANUP, None)
    assert len(h.main_texts(spark.read.parquet(str(tmp_path / "pages"))).collect()) == 60
    stored = sum(f.stat().st_size for f in Path(tmp_path / "shared").rglob("*.parquet"))
    assert 0 < stored < 1.5 * read
    assert spark.conf.get(CLEANUP, None) == before
