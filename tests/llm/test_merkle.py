"""The manifest against a tree built in plain Python, for blocks and tops of several sizes."""

import hashlib
import zlib

import duckdb
import pytest

from folio.llm import merkle
from folio.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def lower(t):
        return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    groups = {}
    for doc_id, text, *rest in rows:
        own = leaf(doc_id, text, *rest)
        other = leaf(doc_id, lower(text), *rest) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else own
        groups.setdefault(rest[0], []).append((doc_id is not None, doc_id or 0, own, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (known, doc_id, own, other) in enumerate(sorted(groups[g])):
            proof, now = "", other
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    low = at // 8 * 8
                    left, right = "".join(level[low:at]), "".join(level[at + 1 : low + 8])
                    proof, now, at = proof + left + right, sha(left + now + right), at // 8
            out.append((doc_id if known else None, own, trees[g][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def rows(n, groups):
    out = [(i * 3, f"Text Nummer {i} é", groups[i * i % len(groups)], None if i % 7 == 0 else f"s{i % 3}", i) for i in range(n)]
    return [*out, (5000, None, None, None, None), (None, "", "", "x", 0), (None, "", "", "x", 0), (None, None, None, None, None), (9, "A", "en", "", None), (9, "A", "en", "", None), (9, "B", "en", "", 1)]


@pytest.mark.parametrize(("n", "groups", "depth", "top"), [(0, ["a"], 3, 4096), (200, ["a", "b", "c"], 3, 4096), (700, ["a"], 1, 20), (600, ["a", "b"], 2, 3), (150, [f"l{k}" for k in range(60)], 1, 10)])
def test_against_a_plain_tree(spark, n, groups, depth, top):
    data = rows(n, groups)
    third = merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA).repartition(5), tampered=third, changes={"text": merkle.F.translate("text", merkle.UPPER, merkle.LOWER)}, depth=depth, top=top)
    assert sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=repr) == brute(data)


def test_sql_on_nulls_and_ties(spark):
    data = rows(130, ["a", None, "", "Z"])
    frame = spark.createDataFrame(data, SCHEMA)
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    want = con.execute(f"select {', '.join(NAMES)} from ({ORACLE_SQL['op12_merkle']})").fetchall()
    assert sorted(want, key=repr) == brute(data)


def test_everything_verifies_and_odd_columns_do_not_clash(spark):
    frame = spark.createDataFrame([(1, "x", "en", "s", 1), (1, "x", "en", "s", 1)], SCHEMA).selectExpr("*", *[f"'c' as {c}" for c in ("g", "key", "digest", "leaf", "pos", "total", "block", "path", "root", "other")])
    assert [r.verified for r in merkle.manifest(frame).collect()] == [True, True]
    assert merkle.audited(frame.limit(0)).collect() == []
    lone = merkle.audited(frame.limit(1)).collect()[0]
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == sha("")
