"""The chunk store, indexing, retrieval and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.operators.embedding import HashingEmbedder
from parlance.operators.parsing import parse_lines
from parlance.plans.index import index
from parlance.plans.queries import QUERIES, transcript_lines
from parlance.plans.retrieve import answers, retrieve
from parlance.sources.store import ChunkStore, last_write, match, payload, where
from parlance.streaming.events import distinct_events, handle_batch, pending_pairs, read_events, run_available
from parlance.streaming.log import LOGGER, log_streams, log_to


def _messages(spark, lines, session="s1"):
    rows = [("proj", session, i, x) for i, x in enumerate(lines)]
    return parse_lines(spark.createDataFrame(rows, "collection string, session_id string, pos int, line string"))


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store"))


def test_writing_again_changes_nothing(spark, store):
    small = HashingEmbedder(64)
    assert store.points().count() == 0 and store.stats().count() == 0
    index(_messages(spark, transcript_lines()), store, 0, embedder=small)
    once = sorted(map(str, payload(store.points()).collect()))
    index(_messages(spark, transcript_lines()), store, 1, embedder=small)
    index(_messages(spark, transcript_lines()), store, 1, embedder=small)
    assert sorted(map(str, payload(store.points()).collect())) == once
    assert store.raw().count() == 3 * len(once)
    assert [tuple(r) for r in store.stats().collect()] == [("proj", len(once))]
    index(_messages(spark, transcript_lines()[:1]), store, 2, embedder=small)  # a shorter file: the turn's text is the newer one
    assert store.points("proj").where("chunk_no = 0 and turn_no = 1").first().text == "[USER] write a parser\n"
    store.compact(store.path + "2")
    assert ChunkStore(spark, store.path + "2").points().count() == len(once)
    java = store.fetch("proj", {"file_path": "M.java", "type": None}, 5).collect()
    assert len(java) == 1 and java[0].text.startswith("class M")
    assert store.fetch(None, {}, 3).count() == 3


def test_counts_and_stats(spark, store, tmp_path):
    small = HashingEmbedder(64)
    n = index(_messages(spark, transcript_lines()), store, 0, embedder=small)
    assert n == store.points().count() > 0
    assert store.get_stats("proj") == {"collection": "proj", "total_points": n, "status": "green"}
    assert store.get_stats("other") == {"collection": "other", "total_points": 0, "status": "green"}
    assert set(ChunkStore(spark, str(tmp_path / "none")).get_stats("proj")) == {"collection", "error"}


def test_newest_turn_only(spark, store):
    index(_messages(spark, transcript_lines()), store, 0, embedder=HashingEmbedder(64), newest_only=True)
    assert {r.turn_no for r in store.points().select("turn_no").collect()} == {3}


def test_filters_reach_the_scan(spark, store):
    index(_messages(spark, transcript_lines()), store, 0, embedder=HashingEmbedder(64))
    plan = store.raw().where(match({"collection": "proj", "file_path": "M.java"})).select("text")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan and "EqualTo(file_path,M.java)" in plan


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    assert df.where(match({"s": None})).count() == 3
    assert df.where(where({"n": {"$gt": 1, "$lte": 3}, "s": {"$ne": "z"}})).count() == 1
    newest = last_write(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None)], "k int, v int, t string"), ["k"], [F.col("v")])
    assert sorted(map(tuple, newest.collect())) == [(1, 2, "y"), (2, 1, None)]


def test_retrieve(spark, store):
    index(_messages(spark, transcript_lines()), store, 0, embedder=HashingEmbedder(256))
    prompts = spark.createDataFrame([("q1", "proj", "a class M that will return 1 int"), ("q2", "elsewhere", "parser")], "qid string, collection string, prompt string")
    found = retrieve(store.points(), prompts, embedder=HashingEmbedder(256), short=64).where("qid = 'q1'").orderBy("ord").collect()
    assert found[0].file_path == "M.java" and found[0].via == "seed"
    assert "[USER] now in java\n" in {r.text for r in found}
    said = {r.qid: json.loads(r.answer)["hookSpecificOutput"]["additionalContext"] for r in answers(store.points(), prompts, embedder=HashingEmbedder(256), short=64).collect()}
    assert 'source="M.java"' in said["q1"] and said["q2"].startswith("No relevant")


def test_event_stream(spark, store, tmp_path):
    folder, events = tmp_path / "proj", tmp_path / "events"
    folder.mkdir(), events.mkdir()
    (folder / "s1.jsonl").write_text("\n".join(transcript_lines()))
    said = [{"hook_event_name": "SessionEnd", "session_id": "s1", "transcript_path": str(folder / "s1.jsonl")}, {"hook_event_name": "Stop", "session_id": "s1", "transcript_path": str(folder / "s1.jsonl"), "stop_hook_active": True}]
    (events / "1.json").write_text("\n".join(map(json.dumps, said)))
    out = str(tmp_path / "answers")

    def turn():
        run = handle_batch(store, out, embedder=HashingEmbedder(256), short=64)
        q = read_events(spark, str(events)).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    turn()
    assert store.points().select("turn_no").distinct().count() == 3
    (events / "2.json").write_text(json.dumps({"hook_event_name": "UserPromptSubmit", "session_id": "s1", "transcript_path": str(folder / "s1.jsonl"), "prompt": "class M"}))
    turn()
    assert "M.java" in spark.read.parquet(out).first().answer


def test_pending_prompts_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    kinds = "session_id string, kind string, event_id long, ts timestamp, prompt string"
    batches = [[("a", "prompt", 1, "p1"), ("b", "stop", 2, None), ("a", "prompt", 3, "p3")], [("a", "stop", 4, None), ("a", "stop", 5, None), ("b", "prompt", 6, "p6")], [("b", "stop", 7, None)]]
    for rows in batches:
        df = spark.createDataFrame([(s, k, i, None, p) for s, k, i, p in rows], kinds).withColumn("ts", F.timestamp_seconds("event_id"))
        df.coalesce(1).write.mode("append").parquet(str(source))
        run_available(pending_pairs(spark.readStream.schema(kinds).parquet(str(source))), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", 3, "p3", 4), ("b", 6, "p6", 7)]


def test_repeated_events(spark, tmp_path):
    source, kinds = tmp_path / "in", "id long, ts timestamp"
    for seconds in ([(1, 0), (1, 0), (2, 60)], [(1, 120), (3, 120)], [(4, 90_000)], [(1, 90_060), (4, 90_060)]):
        spark.createDataFrame([(i, None) for i, _ in seconds], kinds).join(spark.createDataFrame(list(set(seconds)), "id long, s long"), "id").select("id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
        run_available(distinct_events(spark.readStream.schema(kinds).parquet(str(source)), ["id"]), str(tmp_path / "out"), str(tmp_path / "check"))
    # the last event 1 comes a day after the watermark let the first one go
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 1, 2, 3, 4]


def test_repeated_events_before_pairs(spark, tmp_path):
    source, kinds = tmp_path / "in", "session_id string, kind string, event_id long, ts timestamp, prompt string"
    for rows in ([("a", "prompt", 1, "p1"), ("a", "stop", 2, None)], [("a", "prompt", 1, "p1"), ("a", "stop", 3, None)]):
        df = spark.createDataFrame([(s, k, i, None, p) for s, k, i, p in rows], kinds).withColumn("ts", F.timestamp_seconds("event_id"))
        df.coalesce(1).write.mode("append").parquet(str(source))
        events = distinct_events(spark.readStream.schema(kinds).parquet(str(source)), ["event_id"])
        run_available(pending_pairs(events), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1, "p1", 2)]


def test_log(spark, store, tmp_path):
    path, events = tmp_path / "logs" / "engine.log", tmp_path / "events"
    events.mkdir()
    said = [{"hook_event_name": "UserPromptSubmit", "session_id": "s1", "transcript_path": "/p/s1.jsonl", "prompt": "x"}, {"hook_event_name": "Odd", "session_id": "s1"}]
    (events / "1.json").write_text("\n".join(map(json.dumps, said)))
    handler, listener = log_to(str(path)), log_streams(spark)
    assert log_to(str(path)) is handler
    try:
        for broken in (False, True):
            run = handle_batch(store, str(tmp_path / "answers"), embedder=(lambda texts: 1 / 0) if broken else HashingEmbedder(256), short=64)
            q = read_events(spark, str(events)).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / f"c{broken}")).trigger(availableNow=True).start()
            if broken:
                with pytest.raises(Exception):
                    q.awaitTermination()
            else:
                q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
        LOGGER.removeHandler(handler)
        handler.close()
    said = path.read_text()
    assert "batch 0: 1 of UserPromptSubmit" in said and "batch 0: 1 left out, unknown event" in said
    assert "batch 0 failed" in said and "Traceback" in said
    assert "started" in said and "2 rows in" in said


@pytest.mark.parametrize("name", ["code_chunks", "index_conversations", "retrieve_contexts", "json_parse"])
def test_whole_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
