"""Readers and sinks on files of their layouts."""

import json

from pyspark.sql import functions as F

from trajectra.sources import readers, sinks


def test_samples_of_every_layout(spark, tmp_path):
    chat = {"id": "a", "conversations": [{"from": "user", "value": "é"}, {"from": "assistant", "value": "x"}]}
    process = {"id": 7, "process": [1, 2, 3]}
    answer = {"answer": {"train_messages": []}}
    files = {
        "array.json": json.dumps([chat, process]), "wrapped.json": json.dumps({"n": 1, "samples": [answer, {"other": 1}]}), "one.json": json.dumps(process),
        "lines.jsonl": f"{json.dumps(chat)}\n\n{json.dumps(answer)}\n", "empty.json": "", "broken.json": '[{"id": 1', "number.json": "3",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bytes.json").write_bytes(b"\xff\xfe")
    (tmp_path / "other.txt").write_text("[]")
    got = sorted(((r.file.rsplit("/", 1)[-1], r.place, r.layout, r.id, r.n_turns) for r in readers.samples(spark, str(tmp_path)).collect()), key=repr)
    want = [
        ("array.json", 0, "conversations", "a", 2), ("array.json", 1, "process", "7", 3), ("broken.json", None, None, None, None), ("bytes.json", None, None, None, None),
        ("lines.jsonl", 0, "conversations", "a", 2), ("lines.jsonl", 1, "answer", None, 0), ("number.json", None, None, None, None), ("one.json", 0, "process", "7", 3),
        ("wrapped.json", 0, "answer", None, 0), ("wrapped.json", 1, None, None, None),
    ]
    assert got == sorted(want, key=repr)
    back = readers.samples(spark, str(tmp_path)).where("layout = 'conversations'").select(F.from_json("sample", readers.CHATS).alias("s")).first()
    assert back.s.conversations[0].value == "é"
    assert readers.samples(spark, str(tmp_path), "*.none").count() == 0


def test_readers_of_single_files(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"a": 1, "b": 2}')
    assert {r.tool: r.value for r in readers.mapping(spark, str(tmp_path / "map.json")).collect()} == {"a": 1, "b": 2}
    (tmp_path / "split.json").write_text('{"train_idx": [0, 2], "test_idx": [1]}')
    assert {r.idx: r.is_test for r in readers.split(spark, str(tmp_path / "split.json")).collect()} == {0: False, 2: False, 1: True}
    (tmp_path / "best.json").write_text('{"beam": {"width": 5}}')
    assert readers.parameters(spark, str(tmp_path / "best.json")).first().beam.width == 5
    (tmp_path / "log.json").write_text(json.dumps([{"input": "User: find x TIME: now", "output": "API-Request: [Get(id=1)]"}, {"input": "i", "output": "o"}]))
    assert [r.output for r in readers.api_log(spark, str(tmp_path / "log.json")).orderBy("ord").collect()] == ["API-Request: [Get(id=1)]", "o"]
    (tmp_path / "traces.json").write_text(json.dumps([{"requirement": "r", "apis": [{"api_name": "A", "output": "{}"}]}]))
    assert readers.api_traces(spark, str(tmp_path / "traces.json")).first().apis[0].api_name == "A"
    folder = tmp_path / "answers"
    folder.mkdir()
    good = {"answer_generation": {"valid_data": True, "finish_type": "give_answer", "query": "q", "function": [{"name": "f", "description": "d"}]}}
    (folder / "9_x.json").write_text(json.dumps(good, indent=1))
    (folder / "8_y.json").write_text("{broken")
    assert [r.task_id for r in readers.answers(spark, str(folder)).collect()] == ["9_x"]


def test_report_says_that_there_is_more(spark):
    df = spark.range(5).withColumn("x", F.col("id") / 3)
    assert sinks.report(df, "t", ["id", "x"], 5).count("\n") == 7
    assert sinks.report(df, "t", ["id", "x"], 3).endswith("... more than 3 rows")
