"""Sources, sinks and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from arclume.operators import runs
from arclume.sources import media, readers, testset, writers
from arclume.streaming import workers


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿pair_id,n\np1,1\np2,\n".encode())
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "pair_id string, n int").collect()] == [("p1", 1), ("p2", None)]
    (tmp_path / "t.txt").write_text("v1 Abuse 3 9 -1 -1\nshort line\nv2 Fight 5 x 7 8 11\n\n")
    lines = readers.read_tokens(spark, str(tmp_path / "t.txt"), 4)
    got = {r.name: [tuple(x) for x in r.ranges] for r in readers.annotation_pairs(lines, 2).collect()}
    assert got == {"v1": [(3, 9)], "v2": [(7, 8)]}
    assert sorted(r.name for r in readers.read_names(spark, str(tmp_path / "t.txt")).collect())[:2] == ["-1", "-1"]
    (tmp_path / "n.txt").write_text("1,2.5\n3,4\n")
    assert readers.read_numbers(spark, str(tmp_path / "n.txt"), 2).count() == 2
    d = tmp_path / "json"
    d.mkdir()
    (d / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (d / "b.json").write_text('{"a": 3}')
    (d / "c.json").write_text("[broken")
    assert sorted(r.pair for r in readers.read_pairs(spark, str(d)).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']
    assert sorted(r.name for r in readers.list_files(spark, str(d), "*.json").collect()) == ["a.json", "b.json", "c.json"]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "index")
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    writers.upsert_table(a, p, ["k"], "t")
    writers.upsert_table(spark.createDataFrame([("a", 2, "z")], "k string, t int, v string"), p, ["k"], "t")
    writers.upsert_table(spark.createDataFrame([("a", 2, "z")], "k string, t int, v string"), p, ["k"], "t")
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("a", 2, "z"), ("b", 1, "y")]
    # a table that cannot be read is left as it is, and an unfinished swap is taken up
    (tmp_path / "index" / "part-broken.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017
        writers.upsert_table(a, p, ["k"], "t")
    (tmp_path / "index" / "part-broken.parquet").unlink()
    (tmp_path / "index").rename(tmp_path / "index.old")
    writers.upsert_table(a, p, ["k"], "t")
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("a", 1, "x"), ("b", 1, "y")]
    assert not (tmp_path / "index.old").exists() and not (tmp_path / "index.new").exists()
    for _ in range(2):
        writers.write_csv(a, str(tmp_path / "log"), append=True)
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 4
    writers.write_json(a, str(tmp_path / "j"))
    writers.write_features(a, str(tmp_path / "f"), ["k"])
    assert spark.read.parquet(str(tmp_path / "f")).where("k = 'a'").count() == 1
    good, bad = writers.split_unreadable(spark.createDataFrame([(x,) for x in ("[1]", "[1,]", "[1], [2]", '["a"], "b": 1', "1] [2", "[]", None)], "x string"), "x")
    assert [r.x for r in good.collect()] == ["[1]", "[]"] and [r.x for r in bad.collect()] == ["[1,]", "[1], [2]", '["a"], "b": 1', "1] [2"]
    for _ in range(2):
        writers.append_log(a, str(tmp_path / "own"))
    assert sorted(tuple(r) for r in writers.read_log(spark, str(tmp_path / "own"), "v string, k string, t int").collect()) == sorted([("x", "a", 1), ("y", "b", 1)] * 2)
    assert writers.read_log(spark, str(tmp_path / "none"), "v string").count() == 0
    assert spark.createDataFrame([("aGk=",)], "b string").select(writers.decode_image("b")).first()[0] == b"hi"


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 3, t0 + dt.timedelta(seconds=40 * i + (2000 if i > 50 else 0)), "tick" if i % 4 else "error") for i in range(90)]
    src = str(tmp_path / "events")
    spark.createDataFrame(rows, "user_id int, ts timestamp, event_type string").repartition(3).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = workers.fold_progress(stream, "user_id", "event_type", "ts").writeStream.format("memory").queryName("fold").outputMode("update").option("checkpointLocation", str(tmp_path / "c_fold")).start()
    try:
        q.processAllAvailable()
        last = {}
        for r in spark.table("fold").collect():
            if r.messages >= last.get(r.user_id, (0,))[0]:
                last[r.user_id] = tuple(r)[1:]
    finally:
        q.stop()
    assert last == {r.user_id: tuple(r)[1:] for r in runs.progress(batch, "user_id", "event_type", "ts").collect()}
    for name, of in (("counts", lambda d: workers.windowed_counts(d, "ts", "event_type")), ("silent", lambda d: workers.silent_sessions(d, "user_id", "ts"))):
        q = of(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        try:
            q.processAllAvailable()
            got = {tuple(r) for r in spark.table(name).collect()}
        finally:
            q.stop()
        want = {tuple(r) for r in of(batch).collect()}
        # the stream still holds back sessions that the watermark has not passed
        assert got == want if name == "counts" else got and got <= want


def test_workers(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", t, 1, "x"), ("a", t + dt.timedelta(seconds=10), 2, "error"), ("b", t + dt.timedelta(seconds=310), 3, "error")], "w string, ts timestamp, id int, kind string")
    now = F.lit(t + dt.timedelta(seconds=311))
    assert [(r.w, r.idle) for r in workers.stuck(e, "w", "ts", now).collect()] == [("a", 301)]
    assert workers.stuck(e, "w", "ts", F.lit(t + dt.timedelta(seconds=310))).count() == 0
    assert {r.w: r.kind for r in workers.latest_status(e, "w", ["ts", "id"], ["kind"]).collect()} == {"a": "error", "b": "error"}
    chunks = spark.createDataFrame([("v", 0, 2), ("v", 0, 2), ("u", 0, 1)], "v string, c int, n int")
    assert [r.v for r in workers.complete(chunks, "v", "c", "n").collect()] == ["u"]
    tries = spark.createDataFrame([("l", i, i in (1, 2, 4)) for i in range(7)], "l string, i int, bad boolean")
    assert workers.until_open(tries, "l", ["i"], F.col("bad")).count() == 5


def test_checkpoint_folder():
    from arclume.session import is_local

    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[3,2,3000]") and not is_local("yarn")


def test_pair_index(spark, tmp_path):
    """The byte order mark is no part of a name, the last line counts, and a missing file is empty."""
    (tmp_path / "i.csv").write_bytes("\ufeffpair_id,n\na,1\nb,2\na,3\n".encode())
    got = readers.read_pair_index(spark, str(tmp_path / "i.csv"), "pair_id string, n int", "pair_id")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 3), ("b", 2)]
    assert readers.read_pair_index(spark, str(tmp_path / "none.csv"), "pair_id string, n int", "pair_id").count() == 0


def test_media(spark, tmp_path):
    df = spark.createDataFrame([("a", b"xy"), ("b", b"q"), (None, b"z")], "name string, data binary")
    assert sorted(tuple(r) for r in media.write_images(df, "name", "data", str(tmp_path / "img")).collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.path[-1], bytes(r.content)) for r in media.read_images(spark, str(tmp_path / "img")).collect()) == [("a", b"xy"), ("b", b"q")]

    def fail(path):
        raise ValueError(path)

    assert [r.n_frames for r in media.probe_frames(df, "name", fail).collect()] == [-1, -1, -1]

    def broken(prompt, attempt):
        raise OSError("read timed out")

    assert [(r.data, r.error, r.attempts) for r in media.call_model(df, "name", broken, 3).collect()] == [(None, "TIMEOUT: read timed out", 3)] * 2 + [(None, "NO_PROMPT", 0)]
    with pytest.raises(KeyError):
        testset.anomaly_column(df)
