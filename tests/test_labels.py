import pytest

from feedlens import config as C
from feedlens.operators.labels import aggregate_labels
from feedlens.operators.tagging import model_replies, parse_reply, tag_messages, tag_stats, with_rule_label

CASES = [
    ("", "E.无效", "rule:empty", "P3", ["其他"]), ("  ", "E.无效", "rule:empty", "P3", ["其他"]), ("a", "E.无效", "rule:too_short", "P3", ["其他"]), ("😀😀", "E.无效", "rule:pure_emoji", "P3", ["符号表情"]), ("？！。", "E.无效", "rule:pure_emoji", "P3", ["符号表情"]),
    ("哈哈哈", "E.无效", "rule:invalid_kw", "P3", ["其他"]), ("TeSt", "E.无效", "rule:invalid_kw", "P3", ["其他"]), ("好用", "D.情绪", "rule:emotion_pos", "P3", []), ("差评", "D.情绪", "rule:emotion_neg", "P3", []), ("一打字就闪退", "A.Bug", "rule:bug_p0", "P0", ["输入核心"]),
    ("CRASH", "A.Bug", "rule:bug_p0", "P0", ["其他"]), ("希望有皮肤和主题", "B.建议", "rule:suggest", "P3", ["皮肤"]), ("怎么登录", "C.咨询", "rule:question", "P3", ["账号"]), ("怎么" + "很长" * 20 + "？", "C.咨询", "rule:question", "P3", ["其他"]), ("总是卡顿", "A.Bug", "rule:bug_general", "P1", ["性能"]), ("有乱码", "A.Bug", "rule:bug_general", "P2", ["其他"]),
]


def test_rules(spark):
    rows = with_rule_label(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")).orderBy("i").collect()
    assert [(r.text, r.L1, r.rule_name, r.severity, r.L2) for r in rows] == CASES
    assert [r.confidence for r in rows[:1]] == [0.95] and rows[9].reason == "P0 关键词 闪退"


def test_no_rule(spark):
    texts = [(None,), ("今天天气很好",), ("垃圾得很但是句子长一点就不算",), ("怎么" + "很长" * 20,)]
    rows = with_rule_label(spark.createDataFrame(texts, "text string")).collect()
    assert all(r.L1 is None and r.rule_name is None and r.severity is None and r.L2 is None for r in rows)


def test_bad_rules():
    with pytest.raises(ValueError):
        C.TagRules(bug=["("])
    with pytest.raises(ValueError):
        C.TagRules(p0=[])
    with pytest.raises(ValueError):
        C.SignatureRules(priority=("nothing",))


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('x ```json\n{"L1":"A.Bug","L2":["性能","?"],"severity":"P0","confidence":2,"reason":" r "}\n```', ("A.Bug", ["性能"], "P0", 1.0, "r")), ('```\n{"L1":"?"}\n```', ("待定", [], "P3", 0.0, "llm")), ('say {"L1":"C.咨询","confidence":"x"} end', ("C.咨询", [], "P3", 0.0, "llm")),
        ("", ("待定", [], "P3", 0.0, "parse_error: no_json_found")), (None, ("待定", [], "P3", 0.0, "parse_error: no_json_found")), ("{broken}", ("待定", [], "P3", 0.0, "parse_error: JSONDecodeError")), ('{"reason":"' + "长" * 100 + '"}', ("待定", [], "P3", 0.0, "长" * 80)),
    ],
)
def test_reply(spark, reply, want):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(reply,)], "r string").select(parse_reply(F.col("r")).alias("l")).first().l
    assert (r.L1, r.L2, r.severity, r.confidence, r.reason) == want


def test_tagging_with_a_model(spark):
    from pyspark.sql import functions as F

    m = spark.createDataFrame([("1", "好用"), ("2", "我在看书"), ("3", "我在听歌")], "feedback_id string, text string")

    def ask(texts):
        if any("书" not in t for t in texts):
            raise TimeoutError
        return ['{"L1": "C.咨询", "severity": "P3", "confidence": 0.4}'] * len(texts)

    both = m.join(model_replies(m, ask, partitions=2), "feedback_id")
    labels = {r.feedback_id: r for r in tag_messages(both, reply=F.col("reply")).collect()}
    assert labels["1"].source == "rule" and labels["2"].L1 == "C.咨询" and labels["3"].L1 == "待定"
    assert tag_stats(tag_messages(both, reply=F.col("reply"))).first().asDict() == {"by_rule": 1, "by_llm": 1, "pending": 1}


MESSAGES = "feedback_id string, conversation_id string, msg_seq int, ts_ms long, user_vid string, appversion string, channel string, service_vid long, external_chat_url string"
LABELS = "feedback_id string, L1 string, L2 array<string>, severity string, confidence double, reason string, source string"


def aggregate(spark, rows):
    """rows: (seq, ts, version, L1, L2, severity, confidence)."""
    m = [(f"m{k}", "c", r[0], r[1], "u", r[2], "app", None, None) for k, r in enumerate(rows)]
    l = [(f"m{k}", r[3], r[4], r[5], r[6], f"r{k}", "rule") for k, r in enumerate(rows) if r[3]]
    return aggregate_labels(spark.createDataFrame(m, MESSAGES), spark.createDataFrame(l, LABELS)).collect()


def test_aggregation(spark):
    (r,) = aggregate(spark, [(0, 10, "1", "C.咨询", ["账号"], "P3", 0.9), (1, 20, "2", "A.Bug", ["性能", "账号"], "P2", 0.8), (2, 30, "3", "A.Bug", [], "P1", 0.8), (3, 40, "4", None, None, None, None), (4, 5, "5", "E.无效", ["其他"], "P0", 1.0)])
    assert (r.L1, r.confidence, r.reason, r.severity) == ("A.Bug", 0.8, "r1", "P0")
    assert r.L2 == "|".join(sorted(["账号", "性能", "其他"])) and (r.msg_count, r.first_ts_ms, r.last_ts_ms) == (4, 5, 30) and r.appversion == "1"


def test_aggregation_without_message_zero_and_empty(spark):
    (r,) = aggregate(spark, [(2, 30, "3", "待定", None, "P3", 0.0), (1, 20, "2", "D.情绪", [], "P3", 0.5)])
    assert r.L1 == "D.情绪" and r.appversion == "2" and r.L2 == ""
    assert aggregate(spark, [(0, 1, "1", None, None, None, None)]) == []


def test_all_untagged(spark, tmp_path):
    """Every untagged message; a limit only where one is given."""
    from feedlens.operators.tagging import untagged
    from feedlens.queries import QUERIES

    spark.range(24_000).selectExpr("id AS event_id", "id % 50 AS user_id", "timestamp_seconds(1704844800 + id) AS ts", "'click' AS event_type", "1.0D AS value", "concat('{\"k\": ', id % 9, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["untagged_messages"](spark, str(tmp_path)).collect()
    assert len(got) > 500 and [r.ts_ms for r in got] == sorted(r.ts_ms for r in got)
    assert QUERIES["untagged_messages"](spark, str(tmp_path)).collect() == got
    m = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0), ("d", 2)], "feedback_id string, ts_ms long")
    none = m.where("feedback_id = 'd'")
    assert [r.feedback_id for r in untagged(m, none).collect()] == ["c", "a", "b"]
    assert [r.feedback_id for r in untagged(m, none, limit=2).collect()] == ["c", "a"]


def test_all_by_score(spark):
    from feedlens.operators.browse import by_score

    rows = spark.range(120).selectExpr("cast(id as string) AS conversation_id", "id AS last_ts_ms", "nullif(id % 4, 0) AS score")
    got = by_score(rows).collect()
    assert len(got) == 120 and [(r.score or 0, r.last_ts_ms) for r in got] == sorted(((r.score or 0, r.last_ts_ms) for r in got), reverse=True)
    assert by_score(rows, limit=7).collect() == got[:7]


def test_rules_of_files(tmp_path):
    import json

    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value), encoding="utf-8")
        return str(tmp_path / name)

    rules = C.load_tag_rules(put("a", {"p0": ["x"]}))
    assert rules.p0 == ["x"] and rules.bug == C.BUG_PATTERNS and C.load_tag_rules(put("a", {"p0": ["y"]})) == rules  # read once
    assert C.load_signature_rules(put("b", {"groups": {"g": ["w"]}, "priority": ["g"]})).priority == ("g",)
    assert C.load_topics(put("c", {"t": ["w"]})) == {"t": ["w"]}
    for k, (load, bad) in enumerate(((C.load_tag_rules, {"p1": []}), (C.load_tag_rules, {"p0": ["("]}), (C.load_topics, {"t": []}), (C.load_topics, []))):
        with pytest.raises(ValueError):
            load(put(f"bad{k}", bad))


def test_scores_are_joined_before_the_sort(spark, data):
    """A sort by ranges reads its rows for the ranges and for the sort: the joins aren't among what it reads."""
    from feedlens.registry import QUERIES

    assert "Join" not in QUERIES["score_sort"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
