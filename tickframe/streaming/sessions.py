"""Run summaries of sessions still being recorded.

Chunks are the unit of arrival. Two queries run. The first gathers the pieces of each chunk and, batch by
batch, turns the chunks that are whole into partial rows, one per chunk, with the same code as the batch
summary. The second keeps one small state per session and folds partial rows into it, in order. So the
rows of one long session are spread over the cluster, and its state sees one row per 6,000 ticks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickframe.functions.scores import run_id
from tickframe.operators.runs import segment_partials
from tickframe.operators.segments import SEGMENT
from tickframe.schemas import MILESTONE_ADVANCEMENTS, TRACKER
from tickframe.streaming.assembly import BUCKETS, CALL, REPEATED, Reminders, by_bucket, complete_chunks
from tickframe.streaming.runtime import ARRIVED, by_arrival, source_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in assembly.py

CHUNK = "chunk_index"
STREAM = T.StructType([*TRACKER.fields, T.StructField(CHUNK, T.IntegerType()),
                       T.StructField("ts", T.TimestampType()), T.StructField("call_no", T.LongType()),
                       T.StructField("chunk_calls", T.IntegerType())])

_ADDED = ("duration_ticks", "blaze_rods_used", "blaze_rods_collected", "blaze_kills",
          "pearls_used", "deaths")
_EARLIEST = ("portal_build_tick", "dragon_enter_tick", *MILESTONE_ADVANCEMENTS.values())
_PHASE_TICKS = ("overworld_ticks", "nether_ticks", "end_ticks")

_SUMMED = (*_ADDED, *_PHASE_TICKS, "gold_traded", "beds_used")
_MARKS = (*_EARLIEST, "kill_tick")
_TOTALS = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("player_id", T.StringType()),
    *[T.StructField(n, T.LongType()) for n in (*_SUMMED, *_MARKS)],
    T.StructField("complete", T.BooleanType()), T.StructField("chunks", T.IntegerType()),
    T.StructField("missing_chunks", T.IntegerType())])


def read_closed_chunks(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Tracker rows of closed chunks as they land, in any number of files.

    Operators with typed state need ``runtime.stateful_session`` for ``spark``, here and below.
    """
    reader = spark.readStream.schema(STREAM)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drop_duplicates(stream: DataFrame, lateness: str) -> DataFrame:
    """Calls delivered again within the watermark go away.

    ``call_no`` is the call's place in its session's log: two equal calls of one tick are two calls.
    """
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["session_id", "call_no"])


def chunk_windows(stream: DataFrame, lateness: str, length: str = "5 minutes") -> DataFrame:
    """Rows per session and tumbling event-time window."""
    return (stream.withWatermark("ts", lateness)
            .groupBy("session_id", F.window("ts", length))
            .agg(F.count("*").alias("rows"))
            .select("session_id", F.col("window.start").alias("window_start"), "rows"))


def chunk_partials(rows: DataFrame, ticks_per_row: int = 1) -> DataFrame:
    """Partial rows of gathered chunks, with the time of their newest row and whether nothing is missing."""
    return segment_partials(rows, ticks_per_row, by=CHUNK, also=(
        "max(ts) AS closed_at", f"bool_and(outcome = '{CALL}') AS complete"))


def write_partials(stream: DataFrame, path: str, checkpoint: str, rejected_path: str | None = None,
                   ticks_per_row: int = 1, gap_ms: int | None = None, slack: str = "10 seconds", **trigger):
    """Starts the first query: closed chunks to partial rows below ``path``.

    Rows delivered again go to ``rejected_path``, when given. Each batch owns a folder named by its checkpoint
    and number, so a batch that runs again leaves the same rows and another checkpoint destroys nothing.
    """
    source = source_name(checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        # Both tables come from one run of the operator: its output is kept until they are written.
        held = batch.persist()
        try:
            own = f"source={source}/batch={number}"
            chunk_partials(held.where(F.col("outcome") != REPEATED), ticks_per_row).write.mode("overwrite").parquet(f"{path}/{own}")
            if rejected_path is not None:
                held.where(F.col("outcome") == REPEATED).write.mode("overwrite").parquet(f"{rejected_path}/{own}")
        finally:
            held.unpersist()

    gathered = complete_chunks(stream, ["session_id", CHUNK], gap_ms, slack=slack)
    return (gathered.writeStream.outputMode("append").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


_NEVER = -1
_STATE = T.StructType([T.StructField("next", T.IntegerType()), T.StructField("phase", T.IntegerType()),
                       T.StructField("ended", T.BooleanType()), T.StructField("complete", T.BooleanType()),
                       T.StructField("missing", T.IntegerType()), T.StructField("waiting", T.IntegerType()),
                       T.StructField("told", T.BooleanType()), T.StructField("timer", T.LongType()),
                       *[T.StructField(n, T.LongType()) for n in (*_SUMMED, *_MARKS)]])
_PART = T.StructType([*[T.StructField(n, T.LongType()) for n in (
    *_ADDED, "entry_ticks", *_PHASE_TICKS, "gold_given", "entry_gold", "nether_gold", "entry_beds", "end_beds", *_MARKS)],
    T.StructField("exit_phase", T.IntegerType()), T.StructField("ended", T.BooleanType()), T.StructField("complete", T.BooleanType())])


def _fresh() -> dict:
    return ({"next": 0, "phase": 0, "ended": False, "complete": True, "missing": 0,
             "waiting": 0, "told": False, "timer": None}
            | {n: 0 for n in _SUMMED} | {n: _NEVER for n in _MARKS})


def _fold(state: dict, part: dict) -> None:
    """Adds the chunk that follows the ones already folded."""
    before, phase = state["duration_ticks"], state["phase"]
    for name in _ADDED:
        state[name] += part[name]
    for code, name in enumerate(_PHASE_TICKS):
        state[name] += part[name] + (part["entry_ticks"] if phase == code else 0)
    state["gold_traded"] += (part["nether_gold"] + part["gold_given"]
                             + (part["entry_gold"] if phase == 1 else 0))
    state["beds_used"] += part["end_beds"] + (part["entry_beds"] if phase == 2 else 0)
    for name in _EARLIEST:
        if state[name] == _NEVER and part[name] is not None:
            state[name] = before + part[name]
    if part["kill_tick"] is not None:
        state["kill_tick"] = before + part["kill_tick"]
    if part["exit_phase"] is not None:
        state["phase"] = part["exit_phase"]
    state["ended"] = state["ended"] or part["ended"]
    state["complete"] = state["complete"] and part["complete"]
    state["next"] += 1


class _Sessions(StatefulProcessor):
    """State of one session: what is folded, or a mark once it is told, and chunks that wait for earlier ones."""

    def __init__(self, gap_ms: int | None, keep_ms: int):
        self.gap_ms, self.keep_ms = gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = "session_id string, player_id string"
        self.folded = handle.getMapState("folded", own, _STATE)
        self.waiting = handle.getMapState("waiting", f"{own}, chunk int", _PART)
        # The numbers of the chunks that wait, so that those of one session are found without reading the others'.
        self.places = handle.getMapState("places", own, "chunks binary")
        self.reminders = Reminders(handle)

    def _loaded(self, run: tuple) -> dict:
        known = self.folded.getValue(run)
        return _fresh() if known is None else dict(zip(_STATE.names, known))

    def _keep(self, run: tuple, state: dict, until: int | None, due: dict[int, list]) -> None:
        if until is not None:
            state["timer"] = until
            due.setdefault(until, []).append(run)
        self.folded.updateValue(run, tuple(state[n] for n in _STATE.names))

    def _places(self, run: tuple, state: dict) -> list[int]:
        return np.frombuffer(self.places.getValue(run)[0], np.int32).tolist() if state["waiting"] else []

    def _told(self, run: tuple, state: dict, places: list[int], now: int, due: dict[int, list]) -> Row:
        for chunk in places:
            self.waiting.removeKey((*run, chunk))
        if state["waiting"]:
            self.places.removeKey(run)
        self._keep(run, _fresh() | {"told": True}, now + self.keep_ms, due)
        values = [*run, *[state[n] for n in (*_SUMMED, *_MARKS)], state["complete"], state["next"], state["missing"]]
        return Row(**dict(zip(_TOTALS.names, values)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, now, arrived = {}, 0, {}
        for row in rows:
            now = max(now, int(row[ARRIVED].timestamp() * 1000))
            # The first to come of a chunk stays.
            arrived.setdefault((row["session_id"], row["player_id"]), {}).setdefault(row[SEGMENT], tuple(row[n] for n in _PART.names))
        for run, ready in arrived.items():
            yield from self._take(run, ready, now, due)
        for at, runs in due.items():
            self.reminders.add(at, runs)

    def _take(self, run: tuple, ready: dict[int, tuple], now: int, due: dict[int, list]) -> Iterator[Row]:
        state = self._loaded(run)
        if state["told"]:
            return
        places = self._places(run, state)
        waits = set(places)
        ready = {chunk: part for chunk, part in ready.items() if chunk >= state["next"]}
        # Only what has to wait is written to the state.
        while True:
            part = ready.pop(state["next"], None)
            if state["next"] in waits:
                part = self.waiting.getValue((*run, state["next"]))
                self.waiting.removeKey((*run, state["next"]))
                waits.remove(state["next"])
            if part is None:
                break
            _fold(state, dict(zip(_PART.names, part)))
        if state["ended"]:
            yield self._told(run, state, sorted(waits), now, due)
            return
        for chunk, part in ready.items():
            if chunk not in waits:
                self.waiting.updateValue((*run, chunk), part)
                waits.add(chunk)
        if waits != set(places):
            if waits:
                self.places.updateValue(run, (np.array(sorted(waits), np.int32).tobytes(),))
            else:
                self.places.removeKey(run)
        state["waiting"] = len(waits)
        self._keep(run, state, None if self.gap_ms is None else now + self.gap_ms, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, due = expiredTimerInfo.getExpiryTimeInMs(), {}
        for run in self.reminders.take(at):
            state = self._loaded(run)
            if state["timer"] != at:
                continue
            if state["told"]:
                self.folded.removeKey(run)
                continue
            state["complete"], state["timer"] = False, None
            # Chunks behind one that never came, in their order.
            places = self._places(run, state)
            for chunk in places:
                state["missing"] = chunk - state["next"]
                _fold(state, dict(zip(_PART.names, self.waiting.getValue((*run, chunk)))))
            yield self._told(run, state, places, timerValues.getCurrentWatermarkInMs(), due)
        for at, runs in due.items():
            self.reminders.add(at, runs)

    def close(self) -> None:
        pass


def summarise_sessions(partials: DataFrame, gap_ms: int | None = None, keep_ms: int = 7 * 86_400_000,
                       slack: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Session totals, told once when the session ends (R2, R3, R4); -1 marks "never".

    ``partials`` is a stream of partial rows in any order. A chunk waits in the state until the ones before
    it are folded; a chunk seen before is ignored. A session that has been told is remembered for ``keep_ms``,
    so nothing delivered again opens it anew. One that gets nothing for ``gap_ms`` without an END is told as far as it
    came, ``complete`` false; ``missing_chunks`` counts the chunks that later ones have overtaken. ``buckets`` as in
    ``complete_chunks``.
    """
    return by_bucket(by_arrival(partials, slack), ["session_id", "player_id"], buckets).transformWithState(
        _Sessions(gap_ms, keep_ms), outputStructType=_TOTALS, outputMode="Append", timeMode="EventTime")


def read_partials(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Partial rows below ``path`` as they are written, of every checkpoint."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/source=*/batch=*")


def write_totals(totals: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Starts a sink of one folder per batch and checkpoint; a batch that runs again overwrites its own."""
    source = source_name(checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/source={source}/batch={number}")

    return (totals.writeStream.outputMode(mode).foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def read_totals(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/source=*/batch=*")


def write_runs(totals: DataFrame, path: str, checkpoint: str, digits: int = 2, **trigger):
    """Starts the sink of one row per run (R7), partitioned by the first ``digits`` of the run id.

    A run's id is a digest of its session and player, so a run told again, by this checkpoint or by a new
    one, meets its earlier row: a complete row stays before an incomplete one, else the newer stays. Only the
    partitions of a batch's runs are rewritten. The new content is staged first, so a batch that runs again
    after a failure in the middle finds it and loses nothing.
    """
    source = source_name(checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged = f"{path}/_staged/{source}-{number}"
        if not _exists(spark, f"{staged}/_SUCCESS"):
            rows = batch.withColumn("run_id", run_id(F.col("session_id"), F.col("player_id")))
            rows = rows.withColumn("run_bucket", F.substring("run_id", 1, digits)).persist()
            # At most 16 ** digits names.
            buckets = [r[0] for r in rows.select("run_bucket").distinct().collect()]
            merged = rows.withColumn("_new", F.lit(1))
            if buckets and _exists(spark, f"{path}/_ready"):
                old = spark.read.schema(rows.schema).parquet(path).where(F.col("run_bucket").isin(buckets))
                merged = merged.unionByName(old.withColumn("_new", F.lit(0)))
            best = Window.partitionBy("run_bucket", "run_id").orderBy(F.desc("complete"), F.desc("_new"))
            (merged.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best", "_new")
             .write.mode("overwrite").parquet(staged))
            rows.unpersist()
        (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_bucket").parquet(path))
        _touch(spark, f"{path}/_ready")
        _delete(spark, staged)

    return (totals.writeStream.outputMode("append").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    shape = T.StructType([*_TOTALS.fields, T.StructField("run_id", T.StringType()), T.StructField("run_bucket", T.StringType())])
    return spark.read.schema(shape).parquet(path)


def _file(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def _exists(spark: SparkSession, path: str) -> bool:
    system, name = _file(spark, path)
    return system.exists(name)


def _touch(spark: SparkSession, path: str) -> None:
    system, name = _file(spark, path)
    system.create(name, True).close()


def _delete(spark: SparkSession, path: str) -> None:
    system, name = _file(spark, path)
    system.delete(name, True)
