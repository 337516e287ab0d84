"""Landed responses as a batch and as a stream, and writing by key with bad rows set aside."""

import json
import sqlite3

import pytest

from feedlens import schemas
from feedlens.sources import dumps as D
from feedlens.sources.messages import flatten_responses


def response(k, code=0):
    m = {"sender": 0, "type": "text", "timestamp": 1000 + k, "feedbackId": f"m{k}", "content": {"text": f" 闪退 {k} "}, "clientInfo": {"platform": 1, "appversion": "1.0"}, "user": {"userVid": f"u{k}"}}
    return json.dumps({"errCode": code, "results": [{"session": {"userVid": f"u{k}"}, "msgs": [m]}]}, ensure_ascii=False)


def land(spark, path, pull, lines):
    D.dump(spark.createDataFrame([(3600 * (k % 3), 3600 * (k % 3) + 3600, b) for k, b in enumerate(lines)], "start_sec long, end_sec long, body string"), path, pull)


def test_windows_and_problems(spark, tmp_path):
    spark.dataSource.register(D.LandedSource)
    path = f"file://{tmp_path}/raw"
    land(spark, path, "2024-01-01T00", [response(k) for k in range(8)] + [response(8, 7), "<html>502</html>", "[]", '{"errCode": 0}', ""])
    (tmp_path / "raw/2024-01-02T00/window=0-3600").mkdir(parents=True)
    (tmp_path / "raw/2024-01-02T00/window=0-3600/x.txt").write_text(response(99))  # a pull that isn't whole
    rows = spark.read.format("landed").load(path)
    good, bad = D.split_landed(rows)
    assert rows.rdd.getNumPartitions() == 3
    found = flatten_responses(good, start_ms=0, end_ms=10_000, channel="app")
    assert {(r.feedback_id, r.text) for r in found.collect()} == {(f"m{k}", f"闪退 {k}") for k in range(8)}
    assert sorted(r.problem for r in bad.collect()) == ["errCode 7", "no JSON", "no JSON", "no object", "no results"]
    assert {(r.start_sec, r.end_sec) for r in rows.collect()} == {(0, 3600), (3600, 7200), (7200, 10800)}
    with pytest.raises(Exception, match="(?i)exists"):
        land(spark, path, "2024-01-01T00", [response(1)])  # a pull isn't written over


def test_a_stream_of_pulls(spark, tmp_path):
    spark.dataSource.register(D.LandedSource)
    path, seen = f"file://{tmp_path}/raw", []

    def drain():
        stream = spark.readStream.format("landed").load(path)
        run = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.pull for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        run.awaitTermination()

    land(spark, path, "p1", [response(k) for k in range(4)])
    drain()
    land(spark, path, "p2", [response(k) for k in range(3)])
    land(spark, path, "p3", ["broken"])
    drain()
    drain()
    assert [x for x in seen if x] == [["p1"] * 4, ["p2"] * 3 + ["p3"]]


class Sqlite(D.UpsertSink):
    """Labels in a file of sqlite, which refuses a confidence above 1."""

    def upsert(self, rows):
        with sqlite3.connect(self.options["file"], timeout=60) as db:
            db.executemany("INSERT OR REPLACE INTO label VALUES (:feedback_id, :L1, :confidence)", rows)


def test_one_bad_row_is_set_aside(spark, tmp_path):
    spark.dataSource.register(Sqlite)
    file = tmp_path / "labels.db"
    with sqlite3.connect(file) as db:
        db.execute("CREATE TABLE label (feedback_id TEXT PRIMARY KEY, L1 TEXT, confidence REAL CHECK (confidence <= 1))")
    rows = [(f"m{k}", "A.Bug", 2.0 if k in (7, 130) else 0.5, "extra") for k in range(300)]
    kept = schemas.conform(spark.createDataFrame(rows, "feedback_id string, L1 string, confidence double, more string"), "feedback_id string, L1 string, confidence double")
    for _ in range(2):  # by key: a second time changes nothing
        kept.repartition(2).write.format("upsert").mode("append").options(file=str(file), refused=f"file://{tmp_path}/refused", batchRows="50").save()
        with sqlite3.connect(file) as db:
            assert {r[0] for r in db.execute("SELECT feedback_id FROM label")} == {f"m{k}" for k in range(300)} - {"m7", "m130"}
        assert json.loads((tmp_path / "refused/summary.json").read_text()) == {"upserted": 298, "errors": 2}
    refused = [json.loads(line) for f in (tmp_path / "refused").glob("*.json") if f.name != "summary.json" for line in f.read_text().splitlines()]
    assert {r["row"]["feedback_id"] for r in refused} == {"m7", "m130"} and all("IntegrityError" in r["error"] for r in refused)


def test_a_write_that_is_given_up(tmp_path):
    sink = Sqlite({"file": str(tmp_path / "none.db"), "refused": str(tmp_path / "refused")})
    writer = D.UpsertWriter(sink, ["feedback_id", "L1", "confidence"])
    told = writer.write(iter([{"feedback_id": "a", "L1": "x", "confidence": 1.0}]))  # no such table
    assert told.upserted == 0 and told.errors == 1 and len(list((tmp_path / "refused").iterdir())) == 1
    writer.abort([told, None])
    assert not list((tmp_path / "refused").iterdir())
