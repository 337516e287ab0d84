"""Panes and change feeds of a store against its tables read whole."""

from feedlens import config as C
from feedlens import schemas
from feedlens.operators import browse as B
from feedlens.operators import ranking as R
from feedlens.sources.panes import Panes
from feedlens.sources.store import LabelStore

HOUR = 3_600_000
TEXTS = ("打字的时候突然闪退", "键盘总是卡顿", "每次打开都白屏", "语音输入一直用不了", "好用", "频繁自动退出", "升级以后乱码")
START = 1_700_000_000_000


def messages(spark, ids, shift=0):
    rows = [(f"m{k}", f"u{k % 23}", START + shift + k * HOUR // 3, TEXTS[k % 7], ("1.2", "1.3", "", "2.0")[k % 4], "app") for k in ids]
    return schemas.conform(spark.createDataFrame(rows, "feedback_id string, user_vid string, ts_ms long, text string, appversion string, channel string"), schemas.FEEDBACK)


def shown(df):
    return sorted(map(str, df.collect()))


def direct(store, spark, now_ms):
    return shown(R.score_groups(R.candidates(store.conversations(spark), store.messages(spark), now_ms=now_ms), now_ms=now_ms).drop("versions"))


def test_panes_equal_the_direct_answers(spark, tmp_path):
    store = LabelStore(f"{tmp_path}/labels", buckets=4).create(messages(spark, range(900)))
    panes = Panes(f"{tmp_path}/panes", store)
    days = panes.refresh(spark)
    assert days == sorted({r.last_ts_ms // C.DAY_MS for r in store.conversations(spark).collect()}) and len(days) > 10 and panes.refresh(spark) == []
    end = START + 900 * HOUR // 3
    for now in (end, end - 5 * HOUR - 17, end - 3 * C.DAY_MS, (end // C.DAY_MS) * C.DAY_MS, end + 9 * C.DAY_MS):
        assert shown(panes.signatures(spark, now_ms=now).drop("versions")) == direct(store, spark, now)
    for g in ("day", "hour"):
        assert shown(panes.trend(spark, g)) == shown(B.trend(store.conversations(spark), g))
    one = days[5] * C.DAY_MS
    talks = store.conversations(spark)
    assert shown(panes.trend(spark, "day", since=one, until=one + C.DAY_MS - 1)) == shown(B.trend(talks.where(f"last_ts_ms >= {one} and last_ts_ms < {one + C.DAY_MS}"), "day"))
    week = {(r.bucket, r.L1): r.n for r in panes.sliding(spark).collect()}
    by_day = {}
    for r in talks.collect():
        by_day.setdefault((r.last_ts_ms // C.DAY_MS, r.L1), []).append(r)
    assert week[max(week)] == sum(len(v) for (d, k), v in by_day.items() if k == max(week)[1] and days[-1] - 7 < d <= days[-1])


def test_late_messages_replace_their_days_alone(spark, tmp_path):
    store = LabelStore(f"{tmp_path}/labels", buckets=4).create(messages(spark, range(600)))
    panes = Panes(f"{tmp_path}/panes", store)
    every = panes.refresh(spark)
    before = {f.file for f in panes.log(spark).version().files}
    late = messages(spark, [9001], shift=-9001 * HOUR // 3 + 50 * HOUR)
    store.refresh(late)
    days = panes.refresh(spark)
    assert 0 < len(days) <= 2 and set(days) < set(every)
    after = panes.log(spark).version().files
    assert {f.bucket for f in after if f.file not in before} <= set(days) and len({f.file for f in after} & before) > len(before) / 2
    end = START + 200 * HOUR
    assert shown(panes.signatures(spark, now_ms=end, days=30).drop("versions")) == shown(R.score_groups(R.candidates(store.conversations(spark), store.messages(spark), now_ms=end, days=30), now_ms=end).drop("versions"))
    store.refresh(late)  # known already: a version without a change
    assert panes.refresh(spark) == []
    store.log(spark).sweep(keep=1, grace_seconds=-1)
    assert panes.refresh(spark) == []


def test_a_feed_turns_one_version_into_another(spark, tmp_path):
    store = LabelStore(f"{tmp_path}/labels", buckets=8).create(messages(spark, range(100)))
    store.refresh(messages(spark, [200, 201, 202], shift=-150 * HOUR // 3))
    log = store.log(spark)
    for table, key in (("conversations", "conversation_id"), ("messages", "feedback_id")):
        for old, new in ((1, 2), (2, 1)):
            feed = log.changes(table, key, old, new)
            a, b = (log.read(table, log.version(n)) for n in (old, new))
            kept = a.join(feed.select(key), key, "left_anti").select(*a.columns)
            assert shown(kept.unionByName(feed.where("op <> 'delete'").drop("op"))) == shown(b.select(*a.columns))
            ops = {r.op: r["count"] for r in feed.groupBy("op").count().collect()}
            assert ops.get("insert" if old < new else "delete", 0) >= 3 if table == "messages" else sum(ops.values()) > 0
    assert log.changes("messages", "feedback_id", 2, 2).count() == 0
    one, two = ({f.file for f in log.version(n).files if f.table == "messages"} for n in (1, 2))
    read = {"/".join(f.rsplit("/", 3)[1:]) for f in log.changes("messages", "feedback_id", 1, 2).inputFiles()}
    assert read and not read & {"/".join(f.rsplit("/", 3)[1:]) for f in one & two}  # what both have isn't read
    assert log.mark("copy") == 0
    log.set_mark("copy", 1)
    log.set_mark("copy", 2)
    assert log.mark("copy") == 2
