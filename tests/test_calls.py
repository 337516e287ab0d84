"""Model calls are made once: over runs, equal texts, tasks that start again; deadlines and failures stay open."""

import os

from feedlens.operators import calls
from feedlens.operators.reports import score_conversations


def counting(folder):
    """A model that leaves a file for each call with its texts."""
    os.makedirs(folder, exist_ok=True)

    def ask(texts):
        with open(f"{folder}/{os.getpid()}-{os.urandom(6).hex()}", "w", encoding="utf-8") as f:
            f.write("\n".join(texts))
        if any("fail" in t for t in texts):
            raise TimeoutError
        return [t.upper() for t in texts]

    return ask


def asked(folder):
    return sorted(t for n in os.listdir(folder) for t in open(f"{folder}/{n}", encoding="utf-8").read().split("\n"))


def test_a_text_is_asked_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 30}") for i in range(90)] + [(90, None)], "id long, text string")
    log, ask = calls.CallLog(f"file://{tmp_path}/log"), counting(f"{tmp_path}/seen")
    for _ in range(2):
        got = calls.ask_once(rows, log, "p", ask, size=4, partitions=3).collect()
        assert {(r.id, r.reply) for r in got} == {(i, f"T{i % 30}") for i in range(90)} | {(90, "")} and all(r.answered for r in got)
    assert asked(f"{tmp_path}/seen") == sorted({f"t{i}" for i in range(30)} | {""})
    calls.ask_once(rows.limit(1), log, "another prompt", ask)
    calls.ask_once(rows.limit(1), calls.CallLog(log.path, "other"), "p", ask)
    assert len(asked(f"{tmp_path}/seen")) == 33
    log.compact(spark)
    assert len(os.listdir(f"{tmp_path}/log")) == 1 and calls.ask_once(rows, log, "p", ask).where("answered").count() == 91 and len(asked(f"{tmp_path}/seen")) == 33


def test_a_task_that_starts_again(spark, tmp_path):
    """An attempt that is lost after some batches leaves them; the next one asks the rest alone."""
    import pyarrow as pa

    log, ask = calls.CallLog(str(tmp_path / "log")), counting(f"{tmp_path}/seen")
    batch = pa.RecordBatch.from_pydict({"call": [f"c{i}" for i in range(10)], "text": [f"t{i}" for i in range(10)]})
    first = calls._ask(log, ask, 2, None)(iter([batch]))
    assert [next(first).to_pylist()[0]["state"] for _ in range(3)] == ["answered"] * 3
    again = [r for b in calls._ask(log, ask, 2, None)(iter([batch])) for r in b.to_pylist()]
    assert [r["state"] for r in again] == ["known"] * 3 + ["answered"] * 2
    assert asked(f"{tmp_path}/seen") == [f"t{i}" for i in range(10)]


def test_failures_and_deadlines_stay_open(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}" + " fail" * (i == 3)) for i in range(8)], "id long, text string")
    log, ask = calls.CallLog(f"file://{tmp_path}/log"), counting(f"{tmp_path}/seen")
    assert calls.ask_once(rows, log, "p", ask, size=1, seconds=-1).where("answered").count() == 0 and not os.listdir(f"{tmp_path}/seen")
    got = {r.id: (r.answered, r.reply) for r in calls.ask_once(rows, log, "p", ask, size=1).collect()}
    assert got[3] == (False, None) and sum(ok for ok, _ in got.values()) == 7
    calls.ask_once(rows, log, "p", ask, size=1)
    assert len(asked(f"{tmp_path}/seen")) == 9  # the failed one again


def test_scores(spark, tmp_path):
    texts = spark.createDataFrame([(f"c{i}", "abc"[: i % 4]) for i in range(20)], "conversation_id string, text string")
    ask = lambda q, part: [{"score": len(t), "reason": t} for _, t in part if t != "abc"] if len(part) == 1 else []
    log = calls.CallLog(f"file://{tmp_path}/log")
    got = sorted(map(tuple, calls.score_once(texts, log, "q", ask, size=1).collect()))
    assert got == sorted(map(tuple, score_conversations(texts, "q", ask, size=1).collect()))
    assert {r.reason for r in calls.score_once(texts, log, "q2", ask, seconds=-1).collect()} == {"timeout"}


def test_batches_become_one_file(spark, tmp_path):
    """A log has a file for some thousand texts, however small the batches are; what a lost task and failed calls leave is read and asked as before."""
    log, ask = calls.CallLog(f"file://{tmp_path}/log"), counting(f"{tmp_path}/seen")
    rows = spark.createDataFrame([(i, f"t{i}" + " fail" * (i == 3)) for i in range(90)], "id long, text string")
    got = calls.ask_once(rows, log, "p", ask, size=1, partitions=2)
    assert got.where("answered").count() == 89 and len(os.listdir(f"{tmp_path}/log")) <= 2
    calls.ask_once(rows, log, "p", ask, size=1)
    assert len(asked(f"{tmp_path}/seen")) == 91  # the failed one again


def test_a_lost_task_leaves_its_batches(spark, tmp_path):
    """Another run reads them, also if the group is put together while they are read; the task that starts again asks the rest and what failed."""
    import pyarrow as pa

    folder, seen = f"{tmp_path}/log", f"{tmp_path}/seen"
    log, ask = calls.CallLog(folder), counting(seen)
    batch = pa.RecordBatch.from_pydict({"call": [f"c{i}" for i in range(10)], "text": [f"t{i}" for i in range(9)] + ["fail"]})
    answers = lambda: {r.call: r.reply for r in log.answers(spark).collect()}
    lost = calls._ask(log, ask, 2, None)(iter([batch]))
    next(lost), next(lost)
    early = log.answers(spark)
    assert answers() == {f"c{i}": f"T{i}" for i in range(4)}
    assert [b.column(0)[0].as_py() for b in calls._ask(log, ask, 2, None)(iter([batch]))] == ["known"] * 2 + ["answered"] * 2 + ["failed"]
    assert len(os.listdir(folder)) == 1 and answers() == {f"c{i}": f"T{i}" for i in range(8)}
    assert {r.call: r.reply for r in early.collect()} == answers()  # its files have gone
    assert [b.column(0)[0].as_py() for b in calls._ask(log, lambda texts: ["late"] * 2, 2, None)(iter([batch]))] == ["known"] * 4 + ["answered"]
    assert answers() == {f"c{i}": f"T{i}" for i in range(8)} | {"c8": "late", "c9": "late"}


def test_groups_end_after_some_calls(spark, tmp_path, monkeypatch):
    """Files hold FOLD calls, or one batch where that is larger; groups go over the batches that Arrow hands in."""
    import pyarrow as pa

    monkeypatch.setattr(calls, "FOLD", 7)
    part = lambda lo, hi: pa.RecordBatch.from_pydict({"call": [f"c{i}" for i in range(lo, hi)], "text": [f"t{i}" for i in range(lo, hi)]})
    for size, files in ((3, 4), (9, 3)):
        log = calls.CallLog(str(tmp_path / f"log{size}"))
        told = list(calls._ask(log, lambda texts: [t.upper() for t in texts], size, None)(iter([part(0, 5), part(5, 20)])))
        assert sum(b.column(1)[0].as_py() for b in told) == 20 and len(os.listdir(log.path)) == files
        assert {r.call: r.reply for r in log.answers(spark).collect()} == {f"c{i}": f"T{i}" for i in range(20)}
