"""Tokens of a vocabulary, and years that are none."""

import logging
import pickle

import pytest

from folio.providers import BpeCounter
from folio.sources import crawl


def test_tokens_of_a_vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    counter = BpeCounter(tokenizers.path("byte_bpe_50k.json"))
    import tiktoken  # the same vocabulary, counted by another library
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("", "Cash rate targets rose 0.25 points.", "naïve café\n\n12,345", "<|endoftext|> é"):
        assert counter.count(text) == len(other.encode_ordinary(text))
    assert pickle.loads(pickle.dumps(counter)).count("two words") == 2


def test_a_bad_year_is_told(caplog):
    with caplog.at_level(logging.WARNING, logger="folio.sources.crawl"):
        assert crawl.wanted_years("2019, x, 2021-20b, 2022", 2025) == {"2019", "2022"}
    assert [r.getMessage() for r in caplog.records] == ["no year or range of years: 'x'", "no year or range of years: '2021-20b'"]
