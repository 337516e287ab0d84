"""Streamed conversation labels against the batch: late and repeated messages, joins, restarts, state that goes."""

import random

from feedlens import schemas
from feedlens.operators.labels import aggregate_labelled
from feedlens.operators.sessionize import sessionize
from feedlens.operators.tagging import with_label
from feedlens.streaming import conversations as SC

MIN = 60_000
COLUMNS = ["conversation_id", "L1", "L2", "severity", "confidence", "reason", "source", "msg_count", "first_ts_ms", "last_ts_ms", "user_vid", "appversion", "channel", "service_vid", "external_chat_url"]


def messages(spark, rows):
    return schemas.conform(spark.createDataFrame(rows, "feedback_id string, user_vid string, ts_ms long, text string, appversion string"), schemas.FEEDBACK)


def run(spark, parts, path, **options):
    for k, part in enumerate(parts):
        messages(spark, part).coalesce(1).write.parquet(f"{path}/in/part-{k}")
        stream = spark.readStream.schema(schemas.FEEDBACK).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        SC.keep_changes(SC.conversation_changes(stream, **options), f"{path}/out", f"{path}/log").awaitTermination()  # each part is a new start
    return spark.read.option("mergeSchema", "false").parquet(f"{path}/out")


def batch(spark, rows):
    return {tuple(r) for r in aggregate_labelled(with_label(sessionize(messages(spark, rows)))).select(*COLUMNS).collect()}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    texts = ["闪退", "好用", "希望有皮肤", "天气", "垃圾", "候选词错位了", "怎么登录账号？", "   "]
    rows = [(f"m{k}", rng.choice(["u1", "u2", "u3", "", None]), 1_700_000_000_000 + rng.randrange(0, 900) * MIN, rng.choice(texts), rng.choice(["1.0", "2.0"])) for k in range(160)]
    parts = [rows[:60], rows[60:110] + rows[:20], rows[110:]]
    changes = run(spark, parts, tmp_path, late="2 days")
    got = {tuple(r) for r in SC.current(changes).select(*COLUMNS).collect()}
    assert got == batch(spark, rows)
    assert changes.where("op = 'delete'").count() > 0 and changes.groupBy("conversation_id", "batch").count().where("count > 1").count() == 0
    assert spark.conf.get(SC.STORE) != SC.ROCKS


def test_late_messages_move_and_join(spark, tmp_path):
    at = lambda m: 1_700_000_000_000 + m * MIN
    one = [("a", "u", at(100), "闪退", "1"), ("b", "u", at(150), "好用", "1")]
    two = [("c", "u", at(80), "天气", "2"), ("a", "u", at(500), "again", "9")]  # an earlier start; an id that is known
    three = [("d", "u", at(125), "卡顿", "3")]  # joins both
    changes = run(spark, [one, two, three], tmp_path)
    assert {tuple(r) for r in SC.current(changes).select(*COLUMNS).collect()} == batch(spark, one + two[:1] + three)
    assert [r["count"] for r in changes.groupBy("op").count().orderBy("op").collect()] == [2, 4]  # the first start and the second conversation went


def test_closed_conversations_leave_no_state(spark, tmp_path):
    at = lambda m: 1_700_000_000_000 + m * MIN
    parts = [[("a", "u", at(0), "闪退", "1"), ("b", "v", at(0), "好用", "1")], [("c", "w", at(6000), "天气", "1")], [("d", "w", at(6001), "天气", "1"), ("e", "u", at(1), "x", "1")], [("f", "u", at(6010), "闪退", "2")]]
    changes = run(spark, parts, tmp_path, late="1 hour")
    got = {r.conversation_id: r.msg_count for r in SC.current(changes).collect()}
    assert sorted(got.values()) == [1, 1, 1, 2]  # e came too late for the watermark
    assert changes.where("op = 'delete'").count() == 0
    kept = [r for r in spark.read.format("statestore").option("path", f"{tmp_path}/log").option("stateVarName", "folded").load().collect()]
    assert {r.key[0] for r in kept} <= {"u", "w"}


def test_fold_is_the_aggregate():
    m = lambda i, rank, conf, sev, bits: {"ts_ms": i, "feedback_id": str(i), "rank": rank, "L1": f"L{rank}", "confidence": conf, "reason": f"r{i}", "source": "rule", "severity_rank": sev, "severity": f"P{sev}", "bits": bits, "user_vid": f"u{i}", "appversion": "", "channel": "", "service_vid": i, "external_chat_url": ""}
    out = None
    for x in (m(1, 2, 0.5, 1, 1), m(2, 3, 0.4, 0, 2), m(3, 3, 0.4, 3, 4), m(4, 1, 0.9, 2, 2)):
        out = SC.fold(out, x)
    assert (out["L1"], out["reason"], out["confidence"], out["severity"], out["bits"], out["msg_count"], out["first_ts_ms"], out["last_ts_ms"], out["user_vid"]) == ("L3", "r2", 0.4, "P3", 7, 4, 1, 4, "u1")


def test_state_calls_do_not_grow_with_conversations():
    from feedlens.streaming.conversations import _MESSAGE, OpenConversations

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (False if name == "exists" else iter(()))

    class Handle(State):
        getValueState = getListState = getMapState = lambda self, *a: State()

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    class Message(dict):
        asDict = dict.copy

    def needed(n):
        calls.clear()
        one = OpenConversations(10)
        one.init(Handle())
        fixed = dict.fromkeys(_MESSAGE) | {"rank": 1, "severity_rank": 1, "confidence": 0.5, "bits": 0}
        out = list(one.handleInputRows(("u",), iter([Message(fixed, ts_ms=100 * k, feedback_id=str(k)) for k in range(n)]), Times()))
        assert len(out) == n
        return len(calls)

    assert needed(1) == needed(50)
