"""Hook events as streams: incremental indexing, answers, and pending prompts as keyed state."""

import logging
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.parsing import parse_lines
from parlance.plans.index import index
from parlance.plans.retrieve import answers
from parlance.sources.store import ChunkStore
from parlance.sources.transcripts import parse_events, read_lines, rejected, route
from parlance.streaming.log import LOGGER


def read_events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of hook events from JSON lines files that appear in a folder."""
    return parse_events(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder))


def distinct_events(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events whose `keys` no event up to `late` before them had. The state is one row for each key until the watermark passes it.

    For events with ids of their own. Hook events have none, and equal ones may be meant: for them the store's key is what keeps chunks single.
    """
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _log_events(events: DataFrame, batch_id: int) -> None:
    for r in events.groupBy("hook_event_name").count().orderBy(F.desc("count"), "hook_event_name").limit(20).collect():
        LOGGER.info("batch %d: %d of %s", batch_id, r["count"], r.hook_event_name)
    for r in rejected(events).groupBy("reason").count().collect():
        LOGGER.warning("batch %d: %d left out, %s", batch_id, r["count"], r.reason)


def handle_batch(store: ChunkStore, answers_path: str | None = None, **options):
    """A foreachBatch function: Stop indexes the newest turn, SessionEnd the whole transcript, UserPromptSubmit is answered.

    The batch number is the store's batch_id, so a batch that runs again writes what it wrote before. Events are
    counted for the log where there is one; an error is logged and ends the stream, which then runs the batch again.
    """
    embedder, model, scorer = options.pop("embedder", None), options.pop("model", None), options.pop("scorer", None)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = batch.dropDuplicates().persist()
        try:
            if LOGGER.hasHandlers() and LOGGER.isEnabledFor(logging.INFO):
                _log_events(events, batch_id)
            for name, newest in (("SessionEnd", False), ("Stop", True)):
                # one path for each event of this micro-batch, whose size the trigger bounds
                paths = [r.transcript_path for r in route(events, name).select("transcript_path").distinct().collect()]
                if paths:
                    index(parse_lines(read_lines(spark, paths)), store, batch_id, embedder=embedder, model=model, newest_only=newest)
            prompts = route(events, "UserPromptSubmit").select(F.concat_ws(":", "session_id", F.xxhash64("prompt")).alias("qid"), "collection", "prompt").dropDuplicates(["qid"])
            if answers_path and not prompts.isEmpty():
                answers(store.points(), prompts, embedder=embedder, scorer=scorer, **options).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(answers_path)
        except Exception:
            LOGGER.exception("batch %d failed", batch_id)
            raise
        finally:
            events.unpersist()

    return run


PAIR = "session_id string, prompt_id long, prompt string, stop_id long"


def pending_pairs(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Pairs each stop with the prompt that is pending in its session.

    events: session_id, kind (`prompt`, `stop` or other), event_id, ts, prompt. A prompt replaces a pending
    one; a stop without one gives nothing; a prompt that no stop has followed when the watermark (`late`
    behind the newest event) is `minutes` past it is dropped. The state is one prompt a session.
    """
    import pandas as pd

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        pending = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            if r.kind == "prompt":
                pending = (int(r.event_id), r.prompt, int(r.ts.timestamp() * 1000))
            elif r.kind == "stop" and pending is not None:
                out.append((key[0], pending[0], pending[1], int(r.event_id)))
                pending = None
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update(pending)
            state.setTimeoutTimestamp(max(pending[2] + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "prompt_id", "prompt", "stop_id"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("session_id").applyInPandasWithState(run, PAIR, "prompt_id long, prompt string, ts_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there and appends its rows to Parquet files."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
