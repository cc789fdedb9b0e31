"""Structured Streaming forms of sampling, event groups, result sinks and the text cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.fold import EMPTY, INPUT, INPUT_SCHEMA, OUTPUT, STATE, Frames, SampleConfig, fold_input
from ..operators.windows import gap_groups
from ..session import path_exists
from ..sources.cache import cache_split

STRETCH = 1 << 14  # frames a streaming task walks at a time


def stream_sample_frames(frames: DataFrame, cfg: SampleConfig = SampleConfig(), width: int = STRETCH) -> DataFrame:
    """Sampling with the state of each video carried between micro-batches.

    Frames of a video arrive in order of their number; within a batch any order
    is sorted.  A frame at or before the last batch's end is reported as late.
    A task holds the new frames of one video as Arrow data, walks them ``width`` at
    a time in order and hands on each stretch before the next.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seen, (last_idx, gray, opened, relaxed) = state.get[:1] + (state.get[1:],) if state.exists else (-1, EMPTY)
        held = []
        for pdf in batches:
            late = pdf.frame_idx <= seen
            if late.any():
                yield pd.DataFrame({"video_id": key[0], "frame_idx": pdf.frame_idx[late], "outcome": "late", "diff": 0.0})
            if not late.all():
                held.append(pa.RecordBatch.from_pandas(pdf.loc[~late, INPUT].sort_values("frame_idx", kind="stable"), INPUT_SCHEMA, preserve_index=False))
        places = [b.column("frame_idx").to_numpy() for b in held]
        numbers = np.sort(np.concatenate(places)) if places else np.array([], np.int64)
        # frames of one number stay in one stretch
        edges = np.unique(numbers[::width])
        cuts = [[*np.searchsorted(p, edges), len(p)] for p in places]
        for n in range(len(edges)):
            part = pa.Table.from_batches([b.slice(c[n], c[n + 1] - c[n]) for b, c in zip(held, cuts)], INPUT_SCHEMA)
            now = Frames(part, None if last_idx is None else np.array([] if gray is None else gray, np.float64))
            outcomes, diffs, (idx, last, opened, relaxed) = now.walk(cfg, last_idx, None if last_idx is None else -1, opened, relaxed)
            if idx != last_idx:
                last_idx, gray = idx, now.gray[last].tolist()
            yield pd.DataFrame({"video_id": key[0], "frame_idx": now.frame, "outcome": outcomes, "diff": diffs})
        state.update((int(numbers[-1]) if len(numbers) else seen, last_idx, gray, opened, relaxed))

    return fold_input(frames, cfg).groupBy("video_id").applyInPandasWithState(
        step, f"video_id bigint, {OUTPUT}", f"seen bigint, {STATE}", "append", GroupStateTimeout.NoTimeout)


DAY = 86_400_000_000


def event_groups(events: DataFrame, key: str, ts: str, gap_micros: int, width: int = DAY) -> DataFrame:
    """Runs of events of a table whose distance stays at or below the gap.

    A key's time axis is cut into segments of ``width`` microseconds, so a key with
    most of the events is spread over many tasks.
    """
    runs = gap_groups(events.withColumn("us_", F.unix_micros(ts)), [key], "us_", gap_micros, "grp_", width)
    return runs.groupBy(key, "grp_").agg(F.min(ts).alias("start"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).drop("grp_")


GROUP = "start_us long, last_us long, n long, first_id long"


class GroupRuns(StatefulProcessor):
    """Open runs of each key as typed list state; an event-time timer closes those the watermark has passed.

    Rows are taken chunk by chunk: a chunk is first reduced to its own runs, which
    then join the open ones.  The open runs of a key span the watermark's delay
    and a gap, so the list is short however many events there are.
    """

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", GROUP)

    def _joined(self, runs: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for run in sorted(runs):
            if out and run[0] - out[-1][1] <= self.gap:
                start, last, n, first = out[-1]
                out[-1] = (start, max(last, run[1]), n + run[2], min(first, run[3]))
            else:
                out.append(run)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        for part in rows:
            part = part.sort_values("us")
            us, ids = part["us"].to_numpy(), part["event_id"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(us) > self.gap) + 1])
            ends = np.append(cut[1:], len(us))
            runs = self._joined(runs + list(zip(us[cut].tolist(), us[ends - 1].tolist(), (ends - cut).tolist(), np.minimum.reduceat(ids, cut).tolist())))
        yield from self._settled(key, runs, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, [tuple(r) for r in self.open.get()] if self.open.exists() else [], timerValues)

    def _settled(self, key, runs: list[tuple], timers) -> Iterator[pd.DataFrame]:
        """Runs that no event still to come can join leave the state; a timer waits for the first of the others."""
        now = timers.getCurrentWatermarkInMs()
        closed = [r for r in runs if self._end(r) <= now]
        left = [r for r in runs if self._end(r) > now]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(map(self._end, left)))
        else:
            self.open.clear()
        if closed:
            start, last, n, first = zip(*closed)
            yield pd.DataFrame({"key": key[0], "start_us": start, "n": n, "first_id": first})

    def _end(self, run: tuple) -> int:
        return (run[1] + self.gap) // 1000 + 1

    def close(self) -> None:
        pass


def stream_event_groups(events: DataFrame, key: str, ts: str, gap_micros: int, watermark: str) -> DataFrame:
    """The same runs over a stream: those the watermark has closed come out; ``open_event_groups`` reads the others when the stream is at rest."""
    # list state and timers need this store
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, watermark).select(F.col(key).alias("key"), "event_id", F.unix_micros(ts).alias("us"), ts)
    runs = rows.groupBy("key").transformWithStateInPandas(GroupRuns(gap_micros), f"key {kind}, start_us bigint, n bigint, first_id bigint", "append", "eventtime")
    return runs.selectExpr(f"key AS {key}", "timestamp_micros(start_us) AS start", "n", "first_id")


def open_event_groups(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """Runs still open in the state a stopped ``stream_event_groups`` query left in its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.selectExpr(f"key.key AS {key}", "timestamp_micros(list_element.start_us) AS start", "list_element.n AS n", "list_element.first_id AS first_id")


def _write_table(path: str, partition_by: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch writer keyed by the batch number, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/batch={batch_id}")
    return write


def stream_append_results(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None):
    """Append a stream as partitioned files; started with all available input."""
    return df.writeStream.foreachBatch(_write_table(path, partition_by or [])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_cache_fill(items: DataFrame, key: list[str], recognise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, run: str = "0"):
    """Recognise the items of each micro-batch that the cache table does not hold yet and add them.

    Each run writes under its own name, so a new checkpoint on an old cache reads
    all of it and overwrites nothing but its own repeated batches.
    """
    schema = recognise(items).schema

    def fill(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        if path_exists(spark, path):
            cache = spark.read.schema(StructType([*schema.fields, StructField("run", StringType()), StructField("batch", LongType())])).parquet(path)
            fresh = cache_split(fresh, cache.where(f"NOT (run = '{run}' AND batch = {batch_id})").select(*key), key)[1]
        recognise(fresh).write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return items.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressListener(StreamingQueryListener):
    """Passes (query name, batch, input rows) of every finished micro-batch to a callable."""

    def __init__(self, report: Callable[[dict], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        self.report({"query": event.name, "event": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report({"query": p.name, "event": "progress", "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report({"query": str(event.id), "event": "terminated"})


def progress_rows(spark: SparkSession, query) -> DataFrame:
    """Input rows of each micro-batch of a query, from its own progress reports."""
    rows = [(int(p["batchId"]), int(p["numInputRows"])) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch bigint, rows bigint")
