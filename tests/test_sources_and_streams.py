import json

import pytest

from tessera.sources import corpus
from tessera.streaming import sessions


def test_corpus_round_trip(spark, tmp_path):
    tree = {"nid": "b", "kind": "book", "title": "B", "children": [{"nid": "b/ch1", "kind": "chapter", "number": "1", "title": "C", "body_text": "x", "page_start": 1, "page_end": 2, "children": []}]}
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "root": tree}))
    nodes = corpus.read_corpus(spark, str(tmp_path / "c.json")).drop("book_id")
    assert [(r["nid"], r["parent_nid"], r["preorder"]) for r in nodes.orderBy("preorder").collect()] == [("b", "", 0), ("b/ch1", "b", 1)]
    corpus.write_lines(nodes, str(tmp_path / "out"))
    back = corpus.read_lines(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.select(*nodes.columns).collect())) == sorted(map(str, nodes.collect()))
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 9, "root": tree}))
    with pytest.raises(Exception, match="newer than"):
        corpus.read_corpus(spark, str(tmp_path / "c.json")).collect()


def test_sidecar_upsert_and_ids(spark):
    a = spark.createDataFrame([("f1", "x")], "fid string, cap string")
    side = spark.createDataFrame([("f1", "y"), ("f2", "z"), ("f2", "w"), ("", "q")], "fid string, cap string")
    assert sorted(map(tuple, corpus.merge_sidecar(a, side, "fid").collect())) == [("f1", "x"), ("f2", "w"), ("f2", "z")]
    patch = spark.createDataFrame([("f1", None), ("f3", "n")], "fid string, cap string")
    assert sorted(map(tuple, corpus.upsert(a, patch, "fid").collect())) == [("f1", "x"), ("f3", "n")]
    from pyspark.sql import functions as F

    ids = corpus.unique_ids(spark.createDataFrame([(1, "A b"), (2, "a B!"), (3, "")], "k0 int, title string"), F.col("title"), ["k0"])
    assert [r["uid"] for r in ids.orderBy("k0").collect()] == ["a-b", "a-b-2", "book"]


def test_texts(spark, tmp_path):
    (tmp_path / "a.tex").write_text(r"\section{Kernels} A kernel is a function of two points in a space.")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:00 --> 00:02\nHello to all of you out there today.")
    (tmp_path / "c.txt").write_text("no")
    rows = corpus.word_bounded_sentences(corpus.read_texts(spark, str(tmp_path))).collect()
    assert sorted(r["sentence"] for r in rows) == ["Hello to all of you out there today.", "Kernels A kernel is a function of two points in a space."]


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))


def test_gate_remembers_across_batches(spark, tmp_path):
    schema = "session long, seq long, kind string, key string"
    events = stream(spark, tmp_path, [[(1, 1, "say", "a"), (1, 2, "say", "b"), (2, 3, "say", "a")]], schema)
    first = sessions.drain(sessions.gate(events), "gate1").collect()
    assert {(r["session"], r["key"], r["fresh"]) for r in first} == {(1, "a", True), (1, "b", True), (2, "a", True)}
    (tmp_path / "more").mkdir()
    events = stream(spark, tmp_path / "more", [[(1, 1, "say", "a"), (1, 2, "say", "a"), (1, 3, "forget", ""), (1, 4, "say", "a")]], schema)
    assert [r["fresh"] for r in sessions.drain(sessions.gate(events), "gate2").orderBy("seq").collect()] == [True, False, True]


def test_lanes(spark, tmp_path):
    schema = "session long, seq long, lane string, kind string, text string"
    rows = [(1, 1, "main", "say", "m1"), (1, 2, "tangent", "say", "t1"), (1, 3, "main", "say", "m2"), (2, 4, "main", "say", "x"), (2, 5, "main", "pause", ""), (3, 6, "main", "cancel", ""), (3, 7, "main", "say", "no")]
    got = sessions.drain(sessions.merge_lanes(stream(spark, tmp_path, [rows], schema)), "lanes").orderBy("session", "place").collect()
    assert [(r["session"], r["lane"], r["marker"], r["text"]) for r in got] == [(1, "tangent", "start", "t1"), (1, "tangent", "end", ""), (1, "main", "", "m1"), (1, "main", "", "m2")]


def test_first_seen_and_windows(spark, tmp_path):
    schema = "user long, key string, ts timestamp, event_type string, value double"
    from datetime import datetime

    rows = [(1, "a", datetime(2024, 1, 1), "v", 1.0), (1, "a", datetime(2024, 1, 1), "v", 2.0), (2, "a", datetime(2024, 1, 2), "v", 3.0)]
    events = stream(spark, tmp_path, [rows], schema)
    assert sessions.drain(sessions.first_seen_stream(events, ["user", "key"]), "fs").count() == 2
    assert sorted(r["n"] for r in sessions.drain(sessions.windowed_counts(events, "1 day", "1 hour"), "wc", "complete").collect()) == [1, 2]
