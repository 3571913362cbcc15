"""Links of two tokenizers against a walk over both token sequences."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from folio.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def groups_of(text, tokenizers):
    """The groups of whole texts, each tokenized at once; None without tokens."""
    if not text:
        return None
    a, b = tokenizers
    value = alignment.byte_values()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    said = [bytes(value[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(s) != (" " + text).encode() for s in said):
        return None
    at, end, groups, now = [0, 0], [0, 0], [], ([], [])
    while at[0] < len(ids[0]) or at[1] < len(ids[1]):
        k = 0 if end[0] <= end[1] else 1
        now[k].append(ids[k][at[k]])
        end[k] += len(said[k][at[k]])
        at[k] += 1
        if end[0] == end[1]:
            groups.append(now)
            now = ([], [])
    return groups


def brute(rows, tokenizers):
    found = [(i, groups_of(t, tokenizers)) for i, t in rows]
    links = [Counter((x, y) for g, h in groups or [] for x in g for y in h) for _, groups in found]
    count = Counter(k for c in links for k in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, groups), c in zip(found, links, strict=True):
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups or [])
        n = [sum(len(g[k]) for g in groups or []) for k in (0, 1)]
        out.append((i, *n, len(groups or []), sum(c.values()), sum(t for k, t in c.items() if count[k] == most[k[0]]), sum(t * count[k] for k, t in c.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def texts(seed):
    rng = random.Random(seed)
    alphabet = ["a", "B", "the", "tion", "é", "ß", "中", "🙂", "é", "​", " ", " ", "\x00", "\x1c", "\t", "\n", "\r\n", " ", " ", " ", "  ", "'s", "'S", "12", "3", "...", "<s>", "</s>", "<|endoftext|>", "<0x41>", "<unk>"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [None, "", " ", "\n", "  ", "▁", "a ▁ b", "x" * 3000, "ab\n" * 400, "the same words " * 2000, *out, *out[:9]]


@pytest.mark.parametrize("known", [500_000, 40, 0])
def test_against_whole_texts(spark, tokenizers, known):
    rows = [(i, t) for i, t in enumerate(texts(3))]
    got = alignment.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), FIRST, SECOND, known=known)
    want = brute(rows, tokenizers)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want
    assert sum(w[1] == 0 for w in want) < 40 and sum(w[3] < w[1] for w in want) > 100


def test_groups_and_odd_rows(spark, tokenizers):
    rows = [(1, "Hello tokenizers"), (1, "Hello tokenizers"), (None, "Hello"), (None, None), (2, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'x' as {c}" for c in ("row", "links", "times", "link", "n", "best", "salt")])
    got = {(r.doc_id, r.groups, len(r.links)) for r in alignment.align(frame, FIRST, SECOND).collect()}
    shown = {t: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups_of(t, tokenizers)) for _, t in rows if t}
    assert {(g[0], g[1]) for g in got} == {(1, shown["Hello tokenizers"]), (None, shown["Hello"]), (None, None), (2, None)}
    scored = alignment.scored(frame, FIRST, SECOND)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in scored.collect()), key=repr) == brute(rows, tokenizers)
    assert alignment.scored(frame.limit(0), FIRST, SECOND).collect() == []


def test_remembered_units_are_bounded(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "ASKED", 30)
    pair = alignment.Pair(FIRST, SECOND)
    for t in texts(5)[10:80]:
        ((counts, written, _, _),) = pair.texts([t])
        groups = groups_of(t, tokenizers)
        assert (written is None) == (groups is None) and counts[2] == len(groups or [])
    assert len(pair.number) < 200
