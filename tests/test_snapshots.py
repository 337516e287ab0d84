"""Versions of the stored labels: readers, failures, conflicts, what a refresh writes and what is left of it."""

import os

import pytest
from pyspark.sql import functions as F

from feedlens import schemas
from feedlens.sources.snapshots import FULL_EVERY, Conflict, SnapshotLog
from feedlens.sources.store import LabelStore

TEXTS = ("闪退", "好用", "希望有皮肤", "天气")


def messages(spark, ids, users=40):
    rows = [(f"m{k}", f"u{k % users}" if k % 17 else ("", None)[k % 2], 1_000_000 * k, TEXTS[k % 4], "app") for k in ids]
    return schemas.conform(spark.createDataFrame(rows, "feedback_id string, user_vid string, ts_ms long, text string, channel string"), schemas.FEEDBACK)


def shown(store, spark, version=None):
    return [sorted(map(str, df.drop("aggregated_at").collect())) for df in (store.messages(spark, version), store.conversations(spark, version))]


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_readers_keep_their_version(spark, tmp_path):
    store = LabelStore(str(tmp_path), buckets=8).create(messages(spark, range(100)))
    rows, talks = store.messages(spark), store.conversations(spark)  # not yet read
    before = shown(store, spark)
    store.refresh(messages(spark, range(100, 160)))
    assert [sorted(map(str, df.drop("aggregated_at").collect())) for df in (rows, talks)] == before == shown(store, spark, 1)
    assert shown(store, spark) == shown(LabelStore(f"{tmp_path}/all", buckets=3).create(messages(spark, range(160))), spark)


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    store = LabelStore(str(tmp_path), buckets=4).create(messages(spark, range(60)))
    before, held = shown(store, spark), files(tmp_path)
    stage = SnapshotLog.stage

    def broken(self, rows, table, order, file_rows):
        if table == "conversations":
            raise OSError("lost between two writes")
        return stage(self, rows, table, order, file_rows)

    monkeypatch.setattr(SnapshotLog, "stage", broken)
    with pytest.raises(OSError):
        store.refresh(messages(spark, range(60, 70)))
    monkeypatch.undo()
    assert shown(store, spark) == before and store.log(spark).latest() == 1 and files(tmp_path) > held
    assert store.log(spark).sweep(grace_seconds=3600) == 0  # it might still be at work
    assert store.log(spark).sweep(grace_seconds=-1) == len(files(tmp_path) | held) - len(files(tmp_path)) or files(tmp_path) == held
    assert files(tmp_path) == held and shown(store, spark) == before
    store.refresh(messages(spark, range(60, 70)))
    assert shown(store, spark) == shown(LabelStore(f"{tmp_path}/all", buckets=3).create(messages(spark, range(70))), spark)


def test_a_refresh_writes_the_buckets_of_its_users(spark, tmp_path):
    store = LabelStore(str(tmp_path), buckets=16).create(messages(spark, range(2000), users=400))
    log = store.log(spark)
    one = log.version()
    store.refresh(messages(spark, [2001], users=400))
    two = log.version()
    new = {f.file for f in two.files} - {f.file for f in one.files}
    assert {f.bucket for f in two.files if f.file in new} == set(two.touched) and len(two.touched) == 1
    written = sum(f.bytes for f in two.files if f.file in new)
    assert written < 0.2 * sum(f.bytes for f in two.files)
    assert {f.file for f in one.files if f.bucket not in two.touched} <= {f.file for f in two.files}
    store.refresh(messages(spark, []))
    assert log.latest() == 2  # nothing came, nothing was written


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two batches at a time both land: at once where their buckets differ, else the later one starts again."""
    store = LabelStore(str(tmp_path), buckets=8).create(messages(spark, range(200)))
    log = store.log(spark)
    base = log.version()
    mine = [f for f in base.files if f.bucket == 0]
    other = [f for f in base.files if f.bucket == 1]
    assert log.commit(base, mine, mine, [0], {}, 8) == 2
    assert log.commit(base, other, other, [1], {}, 8) == 3  # made from version 1 as well
    with pytest.raises(Conflict):
        log.commit(base, mine, mine, [0], {}, 8)
    commit, raced = SnapshotLog.commit, []

    def late(self, base, *rest):
        if not raced:
            raced.append(1)
            LabelStore(str(tmp_path)).refresh(messages(spark, range(200, 230)))
        return commit(self, base, *rest)

    monkeypatch.setattr(SnapshotLog, "commit", late)
    store.refresh(messages(spark, range(220, 260)))
    monkeypatch.undo()
    assert shown(store, spark) == shown(LabelStore(f"{tmp_path}/all", buckets=3).create(messages(spark, range(260))), spark)
    assert log._claim(log.latest(), "{}") is False


def test_long_logs(spark, tmp_path):
    store = LabelStore(str(tmp_path), buckets=2).create(messages(spark, range(40)))
    log = store.log(spark)
    for k in range(FULL_EVERY + 3):
        base = log.version()
        log.commit(base, [f for f in base.files if f.bucket == k % 2], [f for f in base.files if f.bucket == k % 2], [k % 2], {}, 2)
    assert {f.file for f in log.version().files} == {f.file for f in log.version(1).files}
    assert log.sweep(keep=1, grace_seconds=-1) == 0 and log.numbers()[0] == FULL_EVERY + 1
    assert len(shown(store, spark)[0]) == 40


def test_ranges_leave_files_out(spark, tmp_path):
    store = LabelStore(str(tmp_path), buckets=1).create(messages(spark, range(50)))
    store.refresh(messages(spark, range(500, 520)))
    some = store.messages(spark, since=400_000_000)
    assert {r.feedback_id for r in some.where("ts_ms >= 400000000").collect()} == {f"m{k}" for k in range(500, 520)}
    assert store.messages(spark, since=600_000_000_000).count() == 0


def test_pages_by_key(spark, tmp_path):
    """A walk over all pages is the whole sort; a late page opens no more files than the first; a walk stays in its version."""
    from feedlens.operators.filters import Filters

    store = LabelStore(str(tmp_path), buckets=2, file_rows=40).create(messages(spark, range(0, 200_000, 400), users=500))
    want = [tuple(r) for r in store.conversations(spark).orderBy("last_ts_ms", "conversation_id").select("last_ts_ms", "conversation_id").collect()]
    want.sort(key=lambda r: (-r[0], r[1]))
    every = sum(f.table == "conversations" for f in store.log(spark).version().files)
    got, after, opened = [], None, []
    while True:
        found, after = store.page(spark, after=after, limit=30, span_ms=30 * 400_000_000)
        got += [(r.last_ts_ms, r.conversation_id) for r in found.collect()]
        opened.append(len(found.inputFiles()))
        if len(opened) == 2:
            store.refresh(messages(spark, [300_000]))  # a newer version, which the walk doesn't see
        if after is None:
            break
    assert got == want and max(opened[:-1]) <= opened[0] + 2 < every / 2
    bugs, _ = store.page(spark, Filters(L1="A.Bug", q="闪退"), limit=500)
    every = [r.conversation_id for r in store.conversations(spark).where("L1 = 'A.Bug'").orderBy("last_ts_ms").collect()]
    assert len(every) == 501 and {r.conversation_id for r in bugs.collect()} == set(every[1:])
    none = LabelStore(f"{tmp_path}/none", buckets=2).create(messages(spark, []))
    assert none.page(spark)[0].count() == 0 and none.page(spark)[1] is None


def test_a_text_is_labelled_once(spark, tmp_path, monkeypatch):
    """The rules get the different texts of the messages, a null one among them, and give what they give to all rows."""
    from feedlens.operators import tagging
    from feedlens.sources import store as module

    rows = messages(spark, range(300)).withColumn("text", F.when(F.col("ts_ms") % 3 == 0, F.col("text")))
    plain, asked = tagging.with_label, []

    def counted(df, *args, **named):
        asked.append(df.count())
        return plain(df, *args, **named)

    for where in (tagging, module):
        monkeypatch.setattr(where, "with_label", counted, raising=False)
    store = LabelStore(str(tmp_path), buckets=4).create(rows)
    assert asked == [rows.select("text").distinct().count()] and asked[0] < 300
    own = ["feedback_id", *tagging.LABEL_COLUMNS, "rule_name"]
    assert sorted(map(str, store.messages(spark).select(*own).collect())) == sorted(map(str, plain(rows).select(*own).collect()))


def test_a_refresh_leaves_users_without_a_new_message(spark, tmp_path):
    """Known messages make no version; beside new ones they don't have their own users' buckets written again."""
    store = LabelStore(str(tmp_path), buckets=16).create(messages(spark, range(400), users=80))
    log, before = store.log(spark), shown(store, spark)
    store.refresh(messages(spark, range(400), users=80))
    assert log.latest() == 1 and shown(store, spark) == before
    store.refresh(messages(spark, [*range(300), 401], users=80))
    assert log.latest() == 2 and len(log.version().touched) == 1
    assert shown(store, spark) == shown(LabelStore(f"{tmp_path}/all", buckets=3).create(messages(spark, [*range(400), 401], users=80)), spark)


def test_messages_with_their_kind_are_one_scan(spark, data):
    """Queries that part messages by event_type don't join the events to themselves."""
    from feedlens import adapters as A

    typed = A.messages(spark, data, kind=True)
    assert "Join" not in typed._jdf.queryExecution().optimizedPlan().toString()
    want = A.messages(spark, data).join(A.events(spark, data).selectExpr("'e' || event_id AS feedback_id", "event_type"), "feedback_id")
    assert typed.columns == [*A.messages(spark, data).columns, "event_type"] and typed.exceptAll(want.select(*typed.columns)).isEmpty() and typed.count() == want.count()
