from folio import report
from folio.plans import history
from folio.sources import fetch
from folio.sources.store import Store


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/bucket")
    s.ensure()
    s.ensure()
    (tmp_path / "f").write_bytes(b"abc")
    s.put_file("raw/x/f", str(tmp_path / "f"))
    s.put("raw/y", b"\x00\xff")
    assert s.exists("raw/y") and not s.exists("raw/z") and s.keys() == ["raw/x/f", "raw/y"]
    s.fetch("raw/y", str(tmp_path / "g"))
    assert (tmp_path / "g").read_bytes() == b"\x00\xff"


def test_fetch(spark):
    def answer(url):
        if url.endswith("bad"):
            raise OSError("gone")
        return url.encode()

    urls = spark.createDataFrame([("http://a",), ("http://a",), ("http://bad",), (None,)], "url string")
    got = {r.url: (r.content and bytes(r.content), r.error) for r in fetch.fetched(urls, fetch=answer, tries=1).collect()}
    assert got == {"http://a": (b"http://a", None), "http://bad": (None, "OSError: gone")}


def test_history(spark):
    m = spark.createDataFrame([(0, "s", "user", "hi", 1)], "message_id long, session_id string, role string, content string, created_at long")
    s = spark.createDataFrame([("s", 1)], "session_id string, created_at long")
    turn = spark.createDataFrame([("s", "q", "a", 5), ("t", "r", None, 6)], "session_id string, query_text string, answer string, at long")
    messages, sessions = history.with_turn(m, s, turn)
    assert [tuple(r) for r in messages.orderBy("message_id").collect()] == [(0, "s", "user", "hi", 1), (1, "s", "user", "q", 5), (2, "s", "assistant", "a", 5), (3, "t", "user", "r", 6)]
    assert sorted(r.session_id for r in sessions.collect()) == ["s", "t"]
    runs = spark.createDataFrame([(1, "running", None), (2, "running", None)], "run_id int, status string, summary_metrics string")
    done = spark.createDataFrame([(1, 5, 0.4)], "run_id int, total int, pass_rate double")
    assert {r.run_id: (r.status, r.summary_metrics) for r in history.finished_run(runs, done).collect()} == {1: ("completed", '{"total":5,"pass_rate":0.4}'), 2: ("running", None)}
    assert history.event_rows([("e", {"n": 1})], spark).first().payload == {"n": "1"}


def test_report(spark, tmp_path, capsys):
    t = spark.createDataFrame([(4, "d", 2, "c", 96, ["a"], [["1"]])], "id int, document_id string, page_number int, caption string, accuracy int, headers array<string>, rows array<array<string>>")
    t.write.parquet(f"{tmp_path}/t")
    assert report.main([f"{tmp_path}/t", "stats"]) == 0 and report.main([f"{tmp_path}/t", "doc", "d"]) == 0 and report.main([f"{tmp_path}/t", "export", "4", f"{tmp_path}/out"]) == 0
    out = capsys.readouterr().out
    assert "high: 1" in out and "Table 4, page 2, accuracy 96, 1 rows: c" in out and report.main([]) == 2
