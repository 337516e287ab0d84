import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from feedlens import schemas
from feedlens.operators import jobs, reports
from feedlens.sources import merge as M
from feedlens.sources import messages as SM
from feedlens.sources.windows import day_range, parse_time, resolve_window


def response(msgs, session=None):
    return {"errCode": 0, "results": [{"session": session or {"userVid": "s1", "channel": "c", "serviceVid": None}, "msgs": msgs}]}


def message(ident, ts=5, sender=0, kind="text", **more):
    return {"sender": sender, "type": kind, "timestamp": ts, "feedbackId": ident, "content": {"text": f" {ident}　\n"}, "clientInfo": {"platform": 1}, "tags": ["x", "", "y"]} | more


def test_flatten(spark, tmp_path):
    msgs = [message("a"), message("b", 10), message("c", 11), message("d", sender=1), message("e", kind="image"), message(None), message("", 6), message("f", 0, user={"userVid": "own"}, clientInfo={"platform": 5, "device": "My ANDROID"}), message("g", clientInfo=None, content=None, tags=None)]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, [response(msgs), response([]), {"errCode": 1}])))
    raw = SM.read_responses(spark, str(tmp_path))
    rows = {r.feedback_id: r for r in SM.flatten_responses(raw, start_ms=0, end_ms=10, channel="ch").collect()}
    assert set(rows) == {"a", "b", "f", "g"}
    assert (rows["a"].text, rows["a"].tags, rows["a"].platform, rows["a"].user_vid, rows["a"].service_vid, rows["a"].conversation_id) == ("a", "x|y", "iOS", "s1", 10000, "pending")
    assert (rows["f"].user_vid, rows["f"].platform, rows["g"].text, rows["g"].platform, rows["g"].tags) == ("own", "Android", "", "未知(p=None)", "")
    assert SM.ingest_counts(raw, start_ms=0, end_ms=10).first().asDict() == {"session_count": 2, "msg_count": 9, "user_msg_count": 7, "in_window_count": 6}
    assert ", ".join(f"{n} {t}" for n, t in SM.flatten_responses(raw, start_ms=0, end_ms=10, channel="ch").dtypes) == schemas.FEEDBACK


def test_windows():
    now = datetime(2024, 1, 10, 12, tzinfo=UTC)
    ms = int(now.timestamp() * 1000)
    assert resolve_window(now, ts=(1, 2), last="1h") == (1000, 2000)
    assert resolve_window(now, span=("2024-01-01", "2024-01-02 00:00"), last="1h")[1] == 1704153600000
    assert resolve_window(now, last="90m", date="2024-01-01") == (ms - 5_400_000, ms) and resolve_window(now, date="2024-01-01 07:00") == (1704067200000, 1704153600000) and resolve_window(now) == (ms - 86_400_000, ms)
    assert parse_time("2024-01-01", end_of_day=True) == 1704153599000 and parse_time(None) is None and day_range("2024-01-01") == (1704038400000, 1704124800000)
    for bad in ({"last": "5x"}, {"last": ""}, {"date": "x"}):
        with pytest.raises(ValueError):
            resolve_window(now, **bad)


def test_scans(spark):
    t = spark.createDataFrame([(1, "a", None, None, None, None), (2, "b", "c", "u v", 5, '{"service_vid": 7}'), (3, "c", None, "u", None, '{"service_vid": 7}'), (4, "d", None, "", None, "broken")], "id long, k string, channel string, user_vid string, service_vid long, raw_json string").withColumn("external_chat_url", F.lit(None).cast("string"))
    assert [r.id for r in SM.after_mark(t, t.where("id <= 2"), "id").orderBy("id").collect()] == [3, 4] and SM.after_mark(t, t.where("false"), "id").count() == 4
    filled = {r.id: r for r in SM.backfill(t).collect()}
    assert [filled[i].service_vid for i in (1, 2, 3, 4)] == [10000, 5, 7, 10000] and filled[1].external_chat_url is None and filled[2].external_chat_url == "chat?channel=c&serviceVid=5&userVid=u+v"
    assert SM.lookup(t, id=3, k="zz").first().k == "c" and SM.since(t.withColumn("at", F.col("id") * 86_400_000), "at", now_ms=10 * 86_400_000).count() == 2


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 1), (3, "d", 1), (1, "z", 4)], "k long, v string, at long")
    assert [(r.k, r.v) for r in M.insert_ignore(old, new, "k").collect()] == [(3, "d")]
    assert M.insert_counts(old, new, "k").first().asDict() == {"inserted": 1, "skipped": 3}
    assert sorted((r.k, r.v) for r in M.upsert_latest(old, new, "k", "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in M.replace_keys(old, new.where("k = 2"), new.where("k <= 2"), "k").collect()) == [(2, "c")]
    assert [r.k for r in M.orphans(new, old, "k").distinct().collect()] == [3]
    assert M.insert_ignore(old, new.where("false"), "k").count() == 0


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("c", "A.Bug", "x|y", "P0", 0.5, "r", 2, 0, 1500, None, None, None, "app", "文,本\"")], "conversation_id string, L1 string, L2 string, severity string, confidence double, reason string, msg_count long, first_ts_ms long, last_ts_ms long, user_vid string, appversion string, platform string, channel string, preview_text string")
    M.write_csv(M.csv_rows(rows), str(tmp_path / "csv"))
    got = spark.read.csv(str(tmp_path / "csv"), header=True, escape="\\").first()
    assert list(got.asDict()) == list(M.CSV_COLUMNS) and got.last_ts_human == "1970-01-01T00:00:01" and got.preview_text == '文,本"'
    M.write_json({"t": rows}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/t")).count() == 1
    assert [c for c, _ in schemas.conform(rows, "channel string, other long").dtypes] == ["channel", "other"]


def test_quarantine(spark):
    rows = spark.createDataFrame([("1", "A.Bug", ["性能"], "P0", 0.5), ("", "A.Bug", None, "P0", 0.5), ("3", None, [], "P0", 0.5), ("4", "A.Bug", ["x"], "P0", 0.5), ("5", "A.Bug", [], "P0", None)], "feedback_id string, L1 string, L2 array<string>, severity string, confidence double")
    good, bad = M.split_valid(rows, M.label_problem())
    assert [r.feedback_id for r in good.collect()] == ["1"] and sorted(r.problem for r in bad.collect()) == ["L1", "L2", "confidence", "no id"]


def test_job_moves(spark):
    table = spark.createDataFrame([("a", "pending", None, 0, None, None), ("b", "failed", "e", 0, 1, 2), ("c", "succeeded", None, 3, 1, 2), ("d", "running", None, 0, 1, None)], "job_id string, status string, error_message string, sample_count long, started_at long, finished_at long")
    moves = spark.createDataFrame([("a", "running", 9, None, None), ("b", "pending", 9, None, None), ("c", "pending", 9, None, None), ("d", "failed", 9, "x" * 600, None)], "job_id string, to string, at long, error_message string, sample_count long")
    out, refused = jobs.apply_moves(table, moves)
    got = {r.job_id: r for r in out.collect()}
    assert [got[k].status for k in "abcd"] == ["running", "pending", "succeeded", "failed"] and got["a"].started_at == 9 and got["b"].error_message is None and got["b"].finished_at is None and len(got["d"].error_message) == 500
    assert [r.job_id for r in refused.collect()] == ["c"]


def test_reports(spark):
    m = spark.createDataFrame([("c1", 1, "b" * 600, "iOS", "2"), ("c1", 0, None, "", None), ("c2", 0, "x", "Mac", "1")], "conversation_id string, msg_seq int, text string, platform string, appversion string")
    c = spark.createDataFrame([("c1", "A.Bug", "x|y", "P0", 5)], "conversation_id string, L1 string, L2 string, severity string, last_ts_ms long")
    snap = spark.createDataFrame([("c1", 0, 3, "r"), ("c2", 1, 7, None), ("gone", 2, 3, "")], "conversation_id string, snapshot_order long, score int, reason string")
    s = reports.report_samples(snap, m, c)
    rows = {r.conversation_id: r for r in s.collect()}
    assert set(rows) == {"c1", "c2"} and len(rows["c1"].text) == 500 and rows["c1"].text.startswith(" | bb") and rows["c1"].platform == "" and rows["c2"].ai_score == 0 and rows["c2"].L1 == ""
    stats = {(r["dim"], r["value"]): r["n"] for r in reports.report_stats(s).collect()}
    assert stats[("platform", "未知")] == 1 and stats[("L2", "x|y")] == 1 and stats[("ai_score", "未精筛")] == 1 and stats[("ai_score", "3")] == 1
    assert reports.report_range(s).first().asDict() == {"sample_count": 2, "from_ms": 5, "to_ms": 5}
    assert [r.conversation_id for r in reports.best_samples(s, 1).collect()] == ["c1"] and "未精筛" in [r.line for r in reports.sample_lines(s).collect() if "c2" in r.line][0]


def test_scores(spark):
    t = spark.createDataFrame([(f"c{i}", f"t{i}" if i else None) for i in range(5)], "conversation_id string, text string").coalesce(1)

    def ask(query, batch):
        if any(i == "c4" for i, _ in batch):
            raise TimeoutError
        return [{"score": 9, "reason": None}] if batch[0][0] == "c0" else [{"score": 3, "reason": "x"}] * 2

    got = {r.conversation_id: (r.score, r.reason) for r in reports.score_conversations(t, "q", ask, size=2).collect()}
    assert got == {"c0": (2, ""), "c1": (2, "missing"), "c2": (3, "x"), "c3": (3, "x"), "c4": (2, "timeout")}
    assert [reports.batch_size(n) for n in (50, 51, 201)] == [1, 2, 5] and reports.batch_size(10, 4) == 4
    replies = spark.createDataFrame([('{"score": 3, "reason": "a"}',), ('```json\n[{"score": 5}, {"score": 1}]\n```',), ("no",)], "r string")
    assert [[tuple(x) for x in r.s] if r.s else None for r in replies.select(reports.parse_score(F.col("r")).alias("s")).collect()] == [[(3, "a")], [(2, ""), (1, "")], None]


def test_what_is_read_more_than_once_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([("1", "A.Bug"), ("2", "?"), ("3", "A.Bug")], "id string, L1 string").mapInPandas(counted, "id string, L1 string")
    out = M.import_tables(spark, {"t": (rows, "id string, L1 string", F.when(F.col("L1") == "?", "L1"))}, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [("t", 2, 1, None)] and seen.value == 3
    shape = "conversation_id string, text string, platform string, appversion string, L1 string, L2 string, severity string, last_ts_ms long, ai_score int, reason string, snapshot_order long"
    samples = spark.createDataFrame([("c", "t", "iOS", "1", "A.Bug", "x", "P0", 5, 3, "", 0), ("d", "t", "iOS", "1", "A.Bug", "x", "P0", 5, 3, "", 1)], shape)
    seen.value = 0
    assert reports.report_prompt(samples.mapInPandas(counted, shape), "q").first().prompt.count("会话") == 2 and seen.value == 2
