import hashlib
import random

from feedlens.config import GAP_MS
from feedlens.operators.sessionize import sessionize, sessionize_split

SCHEMA = "feedback_id string, user_vid string, ts_ms long"


def found(df):
    return {r.feedback_id: (r.conversation_id, r.msg_seq) for r in df.collect()}


def model(rows, gap=GAP_MS):
    """Message by message, as the definition says."""
    out, last = {}, {}
    for fid, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        key = user or "anon_" + hashlib.sha1(f"anon:{fid}".encode()).hexdigest()[:12]
        first, before, seq = last.get(key, (None, None, -1))
        first, seq = (ts, 0) if before is None or ts - before > gap else (first, seq + 1)
        last[key] = (first, ts, seq)
        out[fid] = (hashlib.sha1(f"{key}:{first}".encode()).hexdigest()[:12], seq)
    return out


def test_boundaries(spark):
    rows = [("a", "u1", 1000), ("b", "u1", 1000 + GAP_MS), ("c", "u1", 1001 + 2 * GAP_MS), ("d", "u2", 1000), ("e", None, 5), ("f", None, 5), ("g", "", 5)]
    got = found(sessionize(spark.createDataFrame(rows[::-1], SCHEMA)))
    assert got == model(rows)
    assert got["a"] == ("1731dd5c4874", 0) and got["b"] == ("1731dd5c4874", 1) and got["c"][1] == 0 and got["c"][0] != got["a"][0]
    assert len({got[x][0] for x in "efg"}) == 3


def test_empty(spark):
    assert sessionize(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_against_model(spark):
    rng = random.Random(5)
    rows = [(f"m{i}", rng.choice(["u1", "u2", "u3", None]), rng.randrange(0, 40 * 3_600_000)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(sessionize(df)) == model(rows)
    assert found(sessionize_split(df, span_ms=3_600_000)) == model(rows)
    assert found(sessionize_split(df, gap_ms=5_000_000, span_ms=1_000_000)) == model(rows, 5_000_000)


def test_late_message_moves_the_start(spark, tmp_path):
    """The conversation that began later is gone from the store, not left beside the new one."""
    from feedlens import schemas
    from feedlens.sources.store import LabelStore

    full = lambda rows: schemas.conform(spark.createDataFrame(rows, SCHEMA), schemas.FEEDBACK)
    store = LabelStore(str(tmp_path), buckets=2).create(full([("a", "u1", 5000), ("x", "u2", 1)]))
    store.refresh(full([("b", "u1", 4000), ("a", "u1", 9_999_999_999)]))
    want = model([("a", "u1", 5000), ("b", "u1", 4000), ("x", "u2", 1)])
    assert found(store.messages(spark)) == want
    assert {r.conversation_id for r in store.conversations(spark).collect()} == {c for c, _ in want.values()}
