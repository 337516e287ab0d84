from datetime import datetime, timedelta



from feedlens.streaming import messages as ST

SCHEMA = "feedback_id string, user_vid string, ts_ms long"


def test_label_store(spark, tmp_path):
    """Refreshed by late, repeated and unlabelled batches, twice each, a store is what one of all messages is; labels that are there stay."""
    from feedlens import schemas
    from feedlens.operators.sessionize import sessionize_all
    from feedlens.sources.store import LabelStore

    rows = [(f"m{k}", ("u1", "u2", None, "")[k % 4], 1_000_000 * k * (k % 3 + 1), ("闪退", "好用", "希望有皮肤", "天气")[k % 4]) for k in range(40)]
    full = schemas.conform(spark.createDataFrame(rows, SCHEMA + ", text string"), schemas.FEEDBACK)
    shown = lambda s: [sorted(map(str, df.drop("aggregated_at").collect())) for df in (s.messages(spark), s.conversations(spark))]
    want = shown(LabelStore(f"{tmp_path}/all", buckets=3).create(full))
    store = LabelStore(f"{tmp_path}/parts", buckets=3).create(full.where("ts_ms % 3 = 0"))
    for part in (full.where("ts_ms % 3 = 1"), full, full.union(full).limit(0), full.where("user_vid = 'u1'")):
        for _ in range(2):
            store.refresh(part)
    assert shown(store) == want
    whole, busy = (sorted(map(str, sessionize_all(full, busy=n).collect())) for n in (100, 5))
    assert whole == busy


def test_replay_and_open_days(spark):
    from feedlens.sources.messages import open_days, replay

    log = spark.createDataFrame([("2024-01-02", "failed"), ("2024-01-02", "succeeded"), ("2024-01-03", "failed")], "day string, status string")
    days = open_days(log, "2024-01-05", days=4)
    assert [r.day for r in days.collect()] == ["2024-01-01", "2024-01-03", "2024-01-04"]

    def run(day):
        if day.endswith("3"):
            raise OSError("no")

    out = replay(days, run, tries=2)
    assert [tuple(r) for r in out.collect()] == [("2024-01-01", "succeeded", None), ("2024-01-03", "failed", "OSError: no"), ("2024-01-04", "succeeded", None)]
    assert [r.day for r in open_days(log.union(out.select("day", "status")), "2024-01-05", days=4).collect()] == ["2024-01-03"]


def test_scores_in_turns(spark):
    from feedlens.operators.reports import batch_size, report_prompt, score_in_turns

    texts = spark.range(60).selectExpr("cast(id AS string) AS conversation_id", "concat('t', id) AS text")
    ask = lambda q, part: [{"score": 3, "reason": "ok"} for _ in part]
    parts = [p.collect() for p in score_in_turns(texts, "q", ask, turns=4)]
    assert len(parts) == 4 and sum(map(len, parts)) == 60 and {r.score for p in parts for r in p} == {3}
    ticks = iter([0, 1, 99, 99])
    late = [p.collect() for p in score_in_turns(texts, "q", ask, turns=4, seconds=50, clock=lambda: next(ticks))]
    assert len(late) == 2 and sum(map(len, late)) == 60 and {r.reason for r in late[1]} == {"timeout"}
    assert [batch_size(n) for n in (50, 51, 200, 201)] == [1, 2, 2, 5]
    samples = spark.createDataFrame([("c1", "t1", "iOS", "", "A.Bug", "", "P0", 5, 3, "", 0), ("c2", "t2", "", "1.0", "A.Bug", "x", "P1", 6, 0, "", 1)], "conversation_id string, text string, platform string, appversion string, L1 string, L2 string, severity string, last_ts_ms long, ai_score int, reason string, snapshot_order long")
    (r,) = report_prompt(samples, "闪退").collect()
    assert r.prompt.startswith("# 用户反馈分析：闪退\n\n样本数：2\n分类：A.Bug 2\n") and r.prompt.index("c1") < r.prompt.index("c2") and "平台：iOS 1，未知 1" in r.prompt
    assert report_prompt(samples.limit(0), "x").first().prompt.startswith("# 用户反馈分析：x\n\n样本数：0\n分类：无")


def test_windows_and_late_data(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 3, start + timedelta(minutes=30 * i), "view") for i in range(40)]
    spark.createDataFrame(rows + rows[:5], "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, event_type string").parquet(f"{tmp_path}/in")

    def drain(df, name, mode):
        seen = []
        df.writeStream.foreachBatch(lambda b, n: seen.append(b.collect())).option("checkpointLocation", f"{tmp_path}/{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return [r for b in seen for r in b] if mode == "append" else seen[-1]

    assert sorted(r.event_id for r in drain(ST.stream_dedup(stream, "event_id"), "dedup", "append")) == list(range(40))
    got = {(r.user_id, r.session_start): r.msg_count for r in drain(ST.stream_sessions(stream, gap="90 minutes"), "sessions", "complete")}
    assert len(got) == 3  # one gap exactly 90 minutes long doesn't end a session
    trend = {r.bucket_start: r.n for r in drain(ST.stream_trend(stream, bucket="12 hours"), "trend", "complete")}
    assert sum(trend.values()) == 45 and len(trend) == 2
    sliding = drain(ST.stream_trend(stream, bucket="7 days", slide="1 day"), "sliding", "complete")
    assert len(sliding) == 7 and {r.n for r in sliding} == {45}
