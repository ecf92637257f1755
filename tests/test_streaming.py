import json
import os

from pyspark.sql import functions as F

from karst.streaming import traces


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def feed(tmp_path, *files):
    for k, rows in enumerate(files):
        path = tmp_path / f"{k}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in order of change
    return str(tmp_path)


def test_alert_states_over_batches(spark, tmp_path):
    path = feed(tmp_path, [{"name": "a", "t": 0, "bad": True}, {"name": "a", "t": 5, "bad": True}], [{"name": "a", "t": 20, "bad": True}, {"name": "b", "t": 1, "bad": None}], [{"name": "a", "t": 25, "bad": False}])
    stream = traces.files(spark, path, "name string, t double, bad boolean", per_trigger=1)
    got = run(traces.alerts(stream, "name", "t", "bad", 15), "alerts").orderBy("epoch").collect()
    assert [tuple(r) for r in got] == [("a", 0.0, "pending"), ("a", 20.0, "firing"), ("a", 25.0, "inactive")]


def test_fragments_out_of_order(spark, tmp_path):
    path = feed(tmp_path, [{"request_id": "r", "seq": 0, "last": False, "at": 1}, {"request_id": "r", "seq": 2, "last": True, "at": 2}], [{"request_id": "r", "seq": 3, "last": False, "at": 3}])
    got = run(traces.fragments(traces.files(spark, path, "request_id string, seq long, last boolean, at double", per_trigger=1)), "fragments").collect()
    assert {tuple(r) for r in got} == {("r", 2, "order"), ("r", 3, "after_last")}


def test_windows_and_single_keys(spark, tmp_path):
    rows = [{"k": "a", "ts": f"2024-01-01T00:00:{s:02}.000Z"} for s in (1, 1, 2, 31)]
    stream = traces.files(spark, feed(tmp_path, rows), "k string, ts timestamp")
    assert {(r["n"]) for r in run(traces.tumbling(stream, "ts", ["k"]), "tumbling", "complete").collect()} == {2, 1}
    assert run(traces.sliding_rate(stream, "ts", ["k"]), "sliding", "complete").where("n = 3").count() == 6
    assert run(traces.once(stream, "k", "ts"), "once").count() == 1


def test_ledger_holds_each_key_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    stream = traces.files(spark, feed(source, [{"id": "a"}, {"id": "a"}], [{"id": "a"}, {"id": "b"}]), "id string", per_trigger=1)
    for checkpoint in ("c1", "c2"):  # the second run replays all from the start
        traces.idempotent(stream, target, "id", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).select(F.col("id")).collect()) == ["a", "b"]
