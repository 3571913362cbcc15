import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folio.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = ["Hello, World! it's I'LL x² ½ ÀÉß 12 345", "", None, "a b\x85c\x1cd <|endoftext|> e<|startoftext|>f", "Ünïcode İstanbul ΣΑΣ été 漢字 😀", "pre|fix%%% don't!!", "word " * 5000, " \t\r\n ", "ªºµ·«»×÷"]


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers():
    words = packing.Words(PATH)
    for t, got in zip(TEXTS, words.encode([t or "" for t in TEXTS]), strict=True):
        assert [*got.tolist(), 0] == ids_of(t), t


def test_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 3000)
    where, offset, fill = packing.best_fit(lengths, 2048)
    assert fill.max() <= 2048 and len(fill) <= 1.03 * lengths.sum() / 2048
    seen = defaultdict(list)
    for n, b, o in zip(lengths, where, offset, strict=True):
        seen[b].append((o, n))
    for b, parts in seen.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == fill[b]


@pytest.mark.parametrize("group", [8192, 3])
def test_pack_is_whole(spark, group):
    rng = random.Random(3)
    rows = [(i, rng.choice(TEXTS) if i % 9 == 0 else "word " * rng.randint(0, 900), "x") for i in range(160)]
    rows.append(rows[5])
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string").repartition(5)
    out = packing.pack(docs, PATH, group=group).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    for i, t, _ in rows:
        ids = ids_of(t)
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted(set(pieces[i])) == want
    total = sum(r.length for r in out)
    assert len(bins) <= total / 2048 * 1.05 + 2


def test_pack_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
