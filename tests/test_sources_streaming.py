import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import corpus
from lattica.sources import files
from lattica.streaming import events


def test_texts_and_projects(spark, tmp_path):
    for name in ("src/b.kt", "src/a.kt", "build/x.kt", ".git/y.kt", "node_modules/z/q.kt", "readme.md"):
        p = tmp_path / "proj" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"// {name}\nline")
    rows = files.read_project(spark, str(tmp_path / "proj")).collect()
    assert [r["name"] for r in rows] == ["src/a.kt", "src/b.kt"] and rows[0]["text"] == "// src/a.kt\nline"


def test_pairs(spark, tmp_path):
    lines = ["# comment", "", json.dumps({"source": "a", "target": "b"}), json.dumps({"source": "", "target": "b"}), "broken {", json.dumps({"source": "c"}), json.dumps({"source": "d", "target": "e"})]
    (tmp_path / "pairs.jsonl").write_text("\n".join(lines))
    assert sorted((r["line_no"], r["source"], r["target"]) for r in files.read_pairs(spark, str(tmp_path / "pairs.jsonl")).collect()) == [(2, "a", "b"), (6, "d", "e")]
    for stem, go, cj in (("x", "a\nb", "A\nB"), ("y", "a", "A\nB")):
        (tmp_path / f"{stem}.source").write_text(go)
        (tmp_path / f"{stem}.target").write_text(cj)
    got = files.read_program_pairs(spark, str(tmp_path), lambda t: t.split("\n")).collect()
    assert sorted(map(tuple, got)) == [("x", 0, "a", "A"), ("x", 1, "b", "B")]


def test_pairs_of_split_files(spark, tmp_path):
    """A file goes to several tasks, none of which holds it whole; its lines keep their numbers."""
    for name, end in (("a", "\n"), ("b", "\r\n")):
        lines = [("# no" if i % 11 == 0 else "" if i % 7 == 0 else json.dumps({"source": f"{name}{i}\u2028\x85", "target": "t" * (i % 13 * 20)}, ensure_ascii=False)) for i in range(200)]
        (tmp_path / f"{name}.jsonl").write_bytes(end.join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = files.read_pairs(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [i for i in range(200) if i % 11 and i % 7 and i % 13]
    assert sorted((r["path"][-7], r["line_no"], r["source"], len(r["target"])) for r in got) == [(name, i, f"{name}{i}\u2028\x85", i % 13 * 20) for name in "ab" for i in kept]
    assert len({r["task"] for r in got}) > 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0], f"t{i}") for i in range(10)], "id long, v array<float>, t string").repartition(2)
    files.write_text(df, "t", str(tmp_path / "text"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == [f"t{i}" for i in range(10)]
    files.write_json(df.select("id", "t"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 10
    before = sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect())

    def broken(path):
        df.select("t").write.text(path)
        raise RuntimeError("in the middle")

    with pytest.raises(RuntimeError):
        files.replace_atomically(spark, str(tmp_path / "text"), broken)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == before
    files.write_text(df.where("id < 3"), "t", str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["json", "text"]
    seen = []
    assert files.for_each(df, "id", lambda n, own: seen.append((n, [r["id"] for r in own])), rows=4) == 3
    assert seen == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]
    back = files.read_npz(files.npz_table(df, "id", "v", rows=3)).collect()
    assert {r["id"]: np.asarray(r["vector"]).tolist() for r in back} == {i: [float(i), 1.0] for i in range(10)}


def rows(n=40):
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(minutes=7 * i + (600 if i >= 30 else 0)), i % 3, float(i)) for i in range(n)]


SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def test_streams_as_batches(spark, tmp_path):
    batch = spark.createDataFrame(rows(), SCHEMA)
    batch.repartition(3, "event_id").write.parquet(str(tmp_path / "events"))
    read = lambda: events.read_events(spark, str(tmp_path / "events"), batch.schema, 100)
    for i, (f, mode) in enumerate([(lambda e: events.tumbling(e, "ts", "1 hour", ["user_id"], "value"), "complete"), (lambda e: events.sliding(e, "ts", "1 hour", "30 minutes", "value"), "complete"), (lambda e: events.sessions(e, "ts", "30 minutes", ["user_id"]), "complete")]):
        got = sorted(map(tuple, events.run_once(f(read()), f"q{i}", mode).collect()))
        assert got == sorted(map(tuple, f(batch).collect()))
    assert events.run_once(events.first_seen(read(), ["user_id"], "ts", "100 days"), "firsts").count() == events.first_seen(batch, ["user_id"], "ts").count() == 3


def test_running_state(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = events.read_events(spark, str(tmp_path / "events"), spark.createDataFrame([], SCHEMA).schema)
    got = {r["user_id"]: r for r in events.run_once(events.running_ema(stream, "user_id", "ts", "value"), "ema", "update").collect()}
    for user in range(3):
        want = 0.0
        for i in range(user, 40, 3):
            want = want * 0.95 + i * (1 - 0.95)
        assert abs(got[user]["ema"] - want) < 1e-9 and got[user]["n"] == len(range(user, 40, 3))


def test_late_rows_do_not_count(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for k, minutes in enumerate(([0, 1, 2], [300], [310], [1], [600])):
        spark.createDataFrame([(k * 10 + i, start + dt.timedelta(minutes=m), 0, 1.0) for i, m in enumerate(minutes)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = events.read_events(spark, str(tmp_path / "late"), spark.createDataFrame([], SCHEMA).schema)
    out = events.run_once(events.tumbling(stream, "ts", "1 hour", ["user_id"], "value"), "late").collect()
    assert {r["start"]: r["n"] for r in out}[start] == 3


def test_word_query_over_lexed_text(spark):
    docs = spark.createDataFrame([(1, "x := 1")], "doc_id long, text string")
    assert corpus.lex(docs, "doc_id", "text").count() == 3
