import json

import pytest

from karst.sources import readers, sinks, staging


def test_strict_lines_name_their_faults(spark, tmp_path):
    good = json.dumps({"id": "a", "topic": "t", "messages": [{"role": "user", "content": "я"}]}, ensure_ascii=False)
    (tmp_path / "x.jsonl").write_text("\n".join([good, "", "{", "[1]", json.dumps({"id": "b", "extra": 1}), good]))
    read, faults = readers.strict_lines(spark, str(tmp_path / "x.jsonl"))
    assert read.count() == 2 and [r["reason"] for r in faults.orderBy("place").collect()] == ["blank", "json", "object", "keys"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "я\nb", None), (2, None, 0.5)], "k int, t string, v double")
    sinks.json_lines(df, str(tmp_path / "j"))
    assert sorted(map(tuple, readers.lenient_lines(spark, str(tmp_path / "j"), "k int, t string, v double").drop("file").collect())) == sorted(map(tuple, df.collect()))
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "t", "v"]
    assert json.loads(sinks.metrics_row(df.where("k = 1"))) == {"k": 1, "t": "я\nb", "v": None}
    with pytest.raises(ValueError):
        sinks.metrics_row(df)
    assert sinks.markdown(df.where("k = 2")).splitlines()[2] == "| 2 |  | 0.5 |" and "<td>2</td>" in sinks.html(df.where("k = 2"))


def test_checked_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    got = readers.table(spark, str(tmp_path / "t"), need={"id"}, take=["id"], optional=["quality"])
    assert got.columns == ["id", "quality"] and got.where("quality is null").count() == 3
    with pytest.raises(ValueError):
        readers.table(spark, str(tmp_path / "t"), need={"other"})
    with pytest.raises(ValueError):
        readers.versioned(spark, {"v1": []}, "v2")


def test_metric_samples_and_digests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"data": {"result": [{"metric": {"pod": "a"}, "values": [[1, "2.5"], [2, "3"]]}, {"metric": {"pod": "b"}, "value": [3, "NaN"]}]}}))
    got = readers.metric_samples(spark, str(tmp_path / "m.json"))
    assert got.count() == 3 and got.where("metric['pod'] = 'a'").agg({"value": "sum"}).first()[0] == 5.5
    import hashlib

    one = readers.file_digests(spark, str(tmp_path / "m.json")).first()
    assert one["sha256"] == hashlib.sha256((tmp_path / "m.json").read_bytes()).hexdigest()


def test_replace_file_is_idempotent(tmp_path):
    assert sinks.replace_file(tmp_path / "p", b"x") and not sinks.replace_file(tmp_path / "p", b"x")
    with pytest.raises(ValueError):
        sinks.pretty_json(tmp_path / "q", {"a": float("nan")})
    assert [p.name for p in tmp_path.iterdir()] == ["p"]


def test_staged_tables_are_read_back_and_released(spark):
    staged = staging.stage(spark.range(5), "t")
    assert staged.count() == 5
    staging.release(staged)
    with pytest.raises(Exception):
        staged.collect()
