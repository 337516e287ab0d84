from feedlens import config as C
from feedlens.operators import ranking as R

NOW = 2_000_000_000_000
ROW = "conversation_id string, L1 string, L2 string, severity string, confidence double, appversion string, last_ts_ms long, full_text string, top_conf_text string, top_conf_feedback_id string"


def row(i, text="闪退", l2="性能", sev="P0", version="5.4.1", age_h=1, conf=0.9, top=None):
    return (f"c{i}", "A.Bug", l2, sev, conf, version, NOW - age_h * 3_600_000, text, text if top is None else top, f"f{i}")


def groups(spark, rows):
    return R.score_groups(spark.createDataFrame(rows, ROW), now_ms=NOW)


def scores(spark, rows):
    return {r.signature: (r.score, r.dup_count, r.p0_count, r.cross_version, r.recent_24h) for r in groups(spark, rows).collect()}


def test_scores(spark):
    assert scores(spark, [row(1)]) == {"crash|性能|5.4": (7.0, 1, 1, 0, 1)}
    assert scores(spark, [row(1), row(2)])["crash|性能|5.4"][0] == 12.0
    assert scores(spark, [row(1), row(2, version="5.4.2", age_h=30)])["crash|性能|5.4"] == (17.0, 2, 2, 1, 1)
    assert scores(spark, [row(1, version="", age_h=30), row(2, version=None, age_h=30, sev="P1")]) == {"crash|性能|_unknown": (8.0, 2, 1, 0, 0)}


def test_signature(spark):
    got = scores(spark, [row(1, "bug 异常"), row(2, ""), row(3, "乱码 卡死"), row(4, "BUG 卡住", l2=" 账号|性能"), row(5, "卡住", l2="", version="7")])
    assert set(got) == {"garbled|性能|5.4", "lag|账号|5.4", "lag|_unknown|7"}


def test_top_and_texts(spark):
    rows = [row(i, version=f"{i}.1", sev="P1", age_h=i + 30) for i in range(7)] + [row(9, version="0.2", conf=0.95, top="")]
    top = R.top_groups(groups(spark, rows))
    got = top.orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and got[0].signature == "crash|性能|0" and got[0].representative_text == "闪退" and [r.signature for r in got[1:]] == [f"crash|性能|{i}" for i in (1, 2, 3, 4)]
    log = R.push_rows(top, push_date="2024-01-01", created_at=7).orderBy("rank").collect()
    assert len(log) == 5 and log[0].affected_versions == "0.1:1|0.2:1" and log[0].is_empty == 0
    sent = R.mark_delivered(R.push_rows(top, push_date="2024-01-01", created_at=7), push_date="2024-01-01", delivered_at=9)
    assert {r.delivered_at for r in sent.collect()} == {9}
    text = R.push_message(top, R.push_scope(spark.createDataFrame(rows, ROW), groups(spark, rows)), push_date="D").first().markdown
    assert "扫描 8 个 Bug 会话 · 命中 7 个签名" in text and '**1. [P0] 闪退类 · 性能 · 跨版本** · 重复 2 次\n> "闪退"\n> 涉及版本：0.1 (1), 0.2 (1)' in text


def test_empty(spark):
    none = groups(spark, [row(1, "bug")])
    (r,) = R.push_rows(R.top_groups(none), push_date="D", created_at=1).collect()
    assert (r["rank"], r.is_empty, r.signature) == (0, 1, None)
    assert R.push_message(R.top_groups(none), R.push_scope(spark.createDataFrame([], ROW), none), push_date="D").first().markdown.startswith("## 📊 今日无 Top Bug · D")


def test_candidates(spark):
    conv = spark.createDataFrame(
        [("c1", "A.Bug", "性能", "P0", 0.9, "1", NOW), ("c2", "A.Bug", None, "P1", 0.7, None, NOW - 7 * C.DAY_MS), ("c3", "A.Bug", "", "P2", 0.9, "1", NOW), ("c4", "A.Bug", "", "P0", 0.69, "1", NOW), ("c5", "A.Bug", "", "P0", 0.9, "1", NOW - 7 * C.DAY_MS - 1)],
        "conversation_id string, L1 string, L2 string, severity string, confidence double, appversion string, last_ts_ms long",
    )
    m = spark.createDataFrame([("b", "c1", 1, "后"), ("a", "c1", 0, "前"), ("x", "c1", 2, "末"), ("z", "c3", 0, "否")], "feedback_id string, conversation_id string, msg_seq int, text string")
    labels = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("x", 0.9)], "feedback_id string, confidence double")
    got = {r.conversation_id: r for r in R.candidates(conv, m, labels, now_ms=NOW).collect()}
    assert set(got) == {"c1", "c2"}
    assert (got["c1"].full_text, got["c1"].top_conf_text, got["c1"].top_conf_feedback_id) == ("前 || 后 || 末", "后", "b")
    assert (got["c2"].full_text, got["c2"].top_conf_text, got["c2"].L2) == ("", "", "")
