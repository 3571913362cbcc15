import random
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from folio.llm import decontaminate
from tests.llm.test_near_copies import shingles, similar
from tests.llm.test_near_duplicates import brute_fingerprint, roots_of
from tests.llm.test_suffix_dedup import brute


def documents():
    rng = random.Random(8)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 3)))
    sets = {"en": ["the", "ing", "wh"], "de": ["sch", "ü", "ung"]}
    rows = []
    for i in range(150):
        lang = rng.choice(list(sets))
        rows.append([i, " ".join(word(sets[lang]) for _ in range(rng.randint(3, 120))), lang])
    bench = [(k, " ".join(word(sets["en"] + sets["de"]) for _ in range(15))) for k in range(4)]
    shared = " ".join(word(sets["en"]) for _ in range(90))
    for i in (5, 6, 7):
        rows[i][1] += " " + shared
    rows[20][1] = rows[21][1]
    rows[30][1] += " " + bench[1][1]
    base = [word(sets["en"]) + word(sets["en"]) for _ in range(120)]
    for i, changes in ((210, 0), (211, 2), (212, 2), (213, 2), (214, 9)):
        copy = list(base)
        for k in range(changes):
            copy[10 + 11 * k + i % 7] = word(sets["en"]) + "the"
        rows.append([i, " ".join(copy), "en"])
    rows += [[200, None, None], [201, "!!! 123", "en"], [202, "", None], [203, rows[9][1], "en"]]
    return [(i, t, lang, "src", len(t or "")) for i, t, lang in rows], bench


def test_every_stage(spark, tmp_path):
    rows, bench = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = {r[0]: r[1] for r in rows}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language"](spark, d, str(tmp_path))
    assert one.columns == d.columns
    kept = sorted(r.doc_id for r in one.collect())
    assert kept == sorted(i for i in text if i not in (200, 201, 202))
    two = stages["near_copies"](spark, one, str(tmp_path)).collect()
    sets = [shingles(text[i]) for i in kept]
    links = [(a, b) for a in range(len(kept)) for b in range(a) if similar(sets[a], sets[b])]
    left = sorted({kept[r] for r in roots_of(len(kept), links)})
    assert sorted(r.doc_id for r in two) == left and not {203, 21, 211, 212, 213} & set(left) and {210, 214} <= set(left)
    # pairs that fingerprints of 3-word shingles within 2 bits would miss
    prints = [brute_fingerprint(text[i]) for i in kept]
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in links) >= 3
    three = stages["repeated_strings"](spark, spark.createDataFrame(two, d.schema), str(tmp_path))
    assert three.columns == d.columns
    three = {r.doc_id: r for r in three.collect()}
    want = dict(zip(left, brute([text[i] for i in left], 200), strict=True))
    assert {i: len(r.text.encode()) for i, r in three.items()} == {i: w[0] - w[1] for i, w in want.items()}
    assert want[5][1] >= 200 and all(r.n_chars == len(r.text) for r in three.values())
    four = stages["benchmark"](spark, spark.createDataFrame(list(three.values()), d.schema), str(tmp_path))
    ids = sorted(r.doc_id for r in four.collect())
    hits = decontaminate.contaminated_brute([three[i].text for i in left], [(str(k), t) for k, t in bench])
    assert ids == [i for i, h in zip(left, hits, strict=True) if not h[1]] and 30 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in out}) == ids
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "s", 1), (None, a, "en", "s", 1)]
    keep = dict(corpus_pipeline.STAGES)["near_copies"]
    assert [r.doc_id for r in keep(spark, spark.createDataFrame(rows, schema), "").collect()] == [1]
    rows.append((None, b, "en", "s", 1))
    assert sorted(str(r.doc_id) for r in keep(spark, spark.createDataFrame(rows, schema), "").collect()) == ["1", "None", "None"]


def test_clashing_names(spark, tmp_path):
    """Columns of documents named like what the operators add stay as they are."""
    rows, bench = documents()
    clashes = ["score", "rejected", "lang_pred", "body", "spans", "items", "n_words", "kept", "others", "runs", "id", "component_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in clashes])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        if name != "packing":
            assert d.columns == docs.columns
            assert all(r[c] == f"{c}{r.doc_id}" for r in d.collect() for c in clashes)
    assert d.count() > 100


def test_a_very_long_text(spark, tmp_path):
    """A document of a million words passes all stages whole."""
    long = " ".join(f"w{i % 7}x{i}" for i in range(1_000_000))
    rows, bench = documents()
    rows.append((900, long, "en", "src", len(long)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = [r for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id == 900]
    assert sum(r.length for r in out) > 1_000_000


def test_what_stages_left_is_deleted(spark, tmp_path):
    """Only the input of the last stage, and what that stores itself, is there when the run ends."""
    rows, bench = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before)
    assert out.count() > 100
    assert [x for x in left if not x.startswith("packed") and x != "moves"] == ["stage-benchmark"]
