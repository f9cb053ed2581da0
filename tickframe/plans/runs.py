"""Run summaries and their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import runs, segments
from tickframe.plans import workload as W
from tickframe.plans.registry import query
from tickframe.schemas import CALLS_PER_TICK, RUN_SUMMARY, TRACKER
from tickframe.sinks.shared import new_shared_path, write_shared
from tickframe.sources.sizing import input_bytes
from tickframe.streaming import sessions as streaming
from tickframe.streaming.assembly import window_counts
from tickframe.streaming.runtime import stateful_session

_DIGEST = "sha256(session_id || '|player-' || session_id)"
_RUN_ID = "||'-'||".join(f"substr({_DIGEST}, {a}, {n})" for a, n in
                         ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

_SUMMARY_SELECT = f"""
summary AS (
  SELECT {_RUN_ID} AS run_id, session_id, 'player-' || session_id AS player_id,
    'any_percent' AS category, {W.OUTCOME_SQL} = 'win' AS completed, {W.OUTCOME_SQL} AS outcome,
    started_at_ms, duration_ticks, overworld_ticks, nether_ticks, end_ticks, portal_build_tick,
    fortress_enter_tick, bastion_enter_tick, CAST(-1 AS BIGINT) AS stronghold_enter_tick,
    blind_travel_tick, eye_spy_tick, dragon_enter_tick, kill_tick, blaze_rods_used,
    blaze_rods_collected, blaze_kills, pearls_used, beds_used, gold_traded, deaths,
    least(greatest(100 - 5 * greatest(blaze_rods_used - 7, 0) - 2 * greatest(pearls_used - 12, 0)
          - 10 * deaths, 0), 100) AS efficiency_score,
    CASE WHEN nether_ticks > 0 THEN
      CAST(least(greatest(100 - (nether_ticks - 2880) // 144, 0), 100) AS INTEGER)
      ELSE -1 END AS nether_score,
    -1 AS seed_quality, '{W.MOD_VERSION}' AS mod_version
  FROM totals JOIN (SELECT session_id, epoch_us(min(ts)) // 1000 AS started_at_ms
                    FROM tele GROUP BY session_id) USING (session_id))"""
_SUMMARY_SQL = f"WITH {W.TOTALS_SQL},{_SUMMARY_SELECT} SELECT * FROM summary"


@query("tracker_calls", f"""WITH {W.STREAM_SQL}
SELECT session_id, 'player-' || session_id AS player_id, tick, rank, kind, name, delta FROM stream""")
def tracker_calls(spark, sf_dir):
    """Every call that the observed ticks lead to."""
    return W.tracker_stream(W.telemetry(spark, sf_dir)).select(*TRACKER.names)


@query("run_summary", _SUMMARY_SQL)
def run_summary(spark, sf_dir):
    tele = W.telemetry(spark, sf_dir)
    return runs.run_summary(W.tracker_stream(tele), W.sessions(tele), W.TICKS_PER_ROW)


def _totals(spark, sf_dir):
    return runs.session_totals(W.tracker_stream(W.telemetry(spark, sf_dir)), W.TICKS_PER_ROW)


@query("phase_ticks", f"""WITH {W.TOTALS_SQL}
SELECT session_id, overworld_ticks, nether_ticks, end_ticks, duration_ticks FROM totals""")
def phase_ticks(spark, sf_dir):
    return _totals(spark, sf_dir).select(
        "session_id", "overworld_ticks", "nether_ticks", "end_ticks", "duration_ticks")


_MILESTONES = ("portal_build_tick", "dragon_enter_tick", "bastion_enter_tick",
               "fortress_enter_tick", "eye_spy_tick", "blind_travel_tick", "kill_tick")


@query("milestones", f"""WITH {W.TOTALS_SQL}
SELECT session_id, {", ".join(_MILESTONES)} FROM totals""")
def milestones(spark, sf_dir):
    never = F.lit(-1).cast("long")
    return _totals(spark, sf_dir).select(
        "session_id", *[F.coalesce(n, never).alias(n) for n in _MILESTONES])


_COUNTS = ("blaze_rods_used", "blaze_rods_collected", "blaze_kills", "pearls_used", "beds_used",
           "gold_traded", "deaths")


@query("resource_counts", f"""WITH {W.TOTALS_SQL}
SELECT session_id, {", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in _COUNTS)} FROM totals""")
def resource_counts(spark, sf_dir):
    return _totals(spark, sf_dir).select("session_id", *_COUNTS)


@query("outcomes", f"""WITH {W.TOTALS_SQL}
SELECT {W.OUTCOME_SQL} AS outcome, count(*) AS sessions FROM totals GROUP BY ALL""")
def outcomes(spark, sf_dir):
    return (run_summary(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("sessions")))


@query("phase_attribution", f"""WITH {W.STREAM_SQL}
SELECT session_id, tick, kind, name, delta, phase FROM phased WHERE kind <> 'TICK'""")
def phase_attribution(spark, sf_dir):
    stream = W.tracker_stream(W.telemetry(spark, sf_dir))
    return (runs.attribute_phase(stream).where(F.col("kind") != "TICK")
            .select("session_id", "tick", "kind", "name", "delta", "phase"))


_RUNNING = "OVER (PARTITION BY session_id ORDER BY tick ROWS UNBOUNDED PRECEDING)"


@query("live_state", f"""WITH {W.STREAM_SQL},
per_tick AS (
  SELECT session_id, tick, arg_max(phase, rank) AS phase,
    {", ".join(f"sum({v}) AS {n}" for n, v in W.COUNTERS_SQL.items())},
    {", ".join(f"min({v}) AS {n}" for n, v in W.STAMPS_SQL.items())},
    max({W.KILL_SQL}) AS kill_tick
  FROM phased GROUP BY session_id, tick)
SELECT session_id, tick, phase,
  {", ".join(f"CAST(sum({n}) {_RUNNING} AS BIGINT) AS {n}" for n in W.COUNTERS_SQL)},
  {", ".join(f"coalesce(min({n}) {_RUNNING}, -1) AS {n}" for n in W.STAMPS_SQL)},
  coalesce(max(kill_tick) {_RUNNING}, -1) AS kill_tick,
  CAST(-1 AS BIGINT) AS stronghold_enter_tick
FROM per_tick""")
def live_state(spark, sf_dir):
    return runs.live_state(W.tracker_stream(W.telemetry(spark, sf_dir)), W.TICKS_PER_ROW)


@query("summary_json", f"""WITH {W.TOTALS_SQL},{_SUMMARY_SELECT}
SELECT session_id, run_id, outcome, CAST(completed AS VARCHAR) AS completed,
  CAST(kill_tick AS VARCHAR) AS kill_tick, CAST(nether_score AS VARCHAR) AS nether_score,
  30 AS keys
FROM summary""")
def summary_json(spark, sf_dir):
    """Reads a few keys back out of each run's JSON document."""
    documents = runs.summary_json(run_summary(spark, sf_dir))
    read = lambda key: F.get_json_object("json", f"$.{key}").alias(key)
    return documents.select(
        "session_id", *[read(k) for k in ("run_id", "outcome", "completed", "kill_tick", "nether_score")],
        F.size(F.json_object_keys("json")).alias("keys"))


# Chunk length of the streamed sessions, in ticks of the workload.
STREAM_CHUNK_TICKS = 16


def landing_rows(tele):
    """Tracker calls with their chunk, plus the END call of every session."""
    stream = W.tracker_stream(tele)
    ends = tele.groupBy("session_id").agg(F.max("tick").alias("tick"), F.max("ts").alias("ts")).select(
        "session_id", "tick", "ts", F.lit(3).alias("rank"), F.lit("END").alias("kind"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("delta"),
        (F.col("tick") * CALLS_PER_TICK + (CALLS_PER_TICK - 1)).alias("call_no"),
        W.player_id(F.col("session_id")).alias("player_id"))
    chunk = F.call_function("div", F.col("tick"), F.lit(STREAM_CHUNK_TICKS)).cast("int")
    rows = stream.drop(segments.SEGMENT).unionByName(ends).withColumn(streaming.CHUNK, chunk)
    # What the manifest of a closed chunk says of its size; a chunk has a few thousand calls.
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id", streaming.CHUNK))
    return (rows.withColumn("chunk_calls", size.cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
            .select(*streaming.STREAM.names))


def stores(spark, landed: str) -> int:
    """State stores for a stream over ``landed``: one for each 256 KB, up to the session's shuffle partitions.

    A store has a fixed cost in every batch. The number is that of a checkpoint's first run, as Spark keeps it.
    """
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(spark, landed) // (256 << 10))))


def gather(spark, work: str, files_per_batch: int | None = None, **options) -> None:
    """Runs the first streaming query over what has landed since it last ran."""
    session = stateful_session(spark, stores(spark, f"{work}/landing"))
    rows = streaming.read_closed_chunks(session, f"{work}/landing", files_per_batch)
    streaming.write_partials(rows, f"{work}/partials", f"{work}/ckpt-partials", f"{work}/rejected", W.TICKS_PER_ROW,
                             availableNow=True, **options).awaitTermination()


def summarise(spark, work: str, checkpoint: str, **options) -> None:
    """Runs the second one over the partial rows written since."""
    told = F.lit(streaming.CALL).alias("outcome")
    shape = streaming.chunk_partials(spark.createDataFrame([], streaming.STREAM).select("*", told), W.TICKS_PER_ROW).schema
    session = stateful_session(spark, stores(spark, f"{work}/landing"))
    totals = streaming.summarise_sessions(streaming.read_partials(session, f"{work}/partials", shape), **options)
    streaming.write_runs(totals, f"{work}/runs", checkpoint, availableNow=True).awaitTermination()


def land(rows, work: str) -> None:
    rows.write.mode("append").parquet(f"{work}/landing")


@query("stream_summary", _SUMMARY_SQL)
def stream_summary(spark, sf_dir):
    """The run summary computed by Structured Streaming from landed chunks.

    Every chunk lands in two halves and many files, and the first chunk of every session twice.
    """
    tele = W.telemetry(spark, sf_dir)
    work = new_shared_path(spark, "stream")
    rows = write_shared(landing_rows(tele).repartition("session_id", streaming.CHUNK), "stream-calls")
    half = F.pmod(F.xxhash64("call_no"), F.lit(2)) == 0
    for part in (half, ~half, F.col(streaming.CHUNK) == 0):
        land(rows.where(part), work)
    gather(spark, work)
    summarise(spark, work, f"{work}/ckpt-totals")
    return runs.finish_summary(streaming.read_runs(spark, f"{work}/runs"), W.sessions(tele)).select(*RUN_SUMMARY.names)


# Sessions that come a day later, and sessions whose second chunk never comes.
_LATER, _LOST = "CAST(session_id AS INT) % 5 = 4", "CAST(session_id AS INT) % 5 = 1"


@query("stream_runs", f"""WITH {W.TELEMETRY_SQL},
ticks AS (SELECT session_id, tick, max(tick) OVER (PARTITION BY session_id) // {STREAM_CHUNK_TICKS} AS last_chunk
          FROM tele WHERE ord % 2 = 0),
s AS (SELECT session_id, {_LOST} AND max(last_chunk) > 0 AS lost,
        count(*) FILTER (NOT ({_LOST} AND tick // {STREAM_CHUNK_TICKS} = 1)) AS n, max(last_chunk) AS last_chunk
      FROM ticks GROUP BY session_id)
SELECT {_RUN_ID} AS run_id, session_id, n * 600 AS duration_ticks, NOT lost AS complete,
  CAST(last_chunk + 1 - lost::INT AS INTEGER) AS chunks, CAST((lost AND last_chunk > 1)::INT AS INTEGER) AS missing_chunks
FROM s""")
def stream_runs(spark, sf_dir):
    """One row per run, whole or marked as incomplete, written by two checkpoints that know nothing of each other.

    The sessions with a lost chunk are told once later arrivals have shown that nothing comes any more.
    """
    tele = W.telemetry(spark, sf_dir)
    work = new_shared_path(spark, "runs")
    lost = F.expr(_LOST) & (F.col(streaming.CHUNK) == 1)
    rows = write_shared(landing_rows(tele).where(~lost).repartition("session_id", streaming.CHUNK), "stream-calls")
    for part in (~F.expr(_LATER), F.expr(_LATER)):
        land(rows.where(part), work)
        gather(spark, work)
        summarise(spark, work, f"{work}/ckpt-1", gap_ms=1, slack="0 seconds")
    summarise(spark, work, f"{work}/ckpt-2")
    return streaming.read_runs(spark, f"{work}/runs").select("run_id", "session_id", "duration_ticks", "complete", "chunks", "missing_chunks")


@query("stream_rejects", f"""WITH {W.STREAM_SQL},
d AS (SELECT session_id, tick // {STREAM_CHUNK_TICKS} AS chunk FROM stream
      UNION ALL SELECT session_id, max(tick) // {STREAM_CHUNK_TICKS} FROM tele GROUP BY session_id)
SELECT session_id, CAST(count(*) + count(*) FILTER (chunk % 2 = 0) AS BIGINT) AS delivered, count(*) AS kept,
  count(*) FILTER (chunk % 2 = 0) AS repeated
FROM d GROUP BY session_id""")
def stream_rejects(spark, sf_dir):
    """Calls delivered, passed on once, and set aside as repeated.

    Every chunk comes in two halves, in two runs of the stream; every second chunk comes whole again in the later one.
    """
    work = new_shared_path(spark, "rejects")
    rows = write_shared(landing_rows(W.telemetry(spark, sf_dir)), "stream-calls")
    half = F.pmod(F.xxhash64("call_no"), F.lit(2)) == 0
    for parts in ((half,), (~half, F.col(streaming.CHUNK) % 2 == 0)):
        for part in parts:
            land(rows.where(part), work)
        session = stateful_session(spark, stores(spark, f"{work}/landing"))
        gathered = streaming.complete_chunks(streaming.read_closed_chunks(session, f"{work}/landing"), ["session_id", streaming.CHUNK])
        streaming.write_totals(gathered, f"{work}/out", f"{work}/ckpt", availableNow=True).awaitTermination()
    out = spark.read.schema("session_id string, outcome string").parquet(f"{work}/out/source=*/batch=*")
    count = lambda which: F.count_if(F.col("outcome") == which)
    delivered = spark.read.parquet(f"{work}/landing").groupBy("session_id").agg(F.count(F.lit(1)).alias("delivered"))
    return delivered.join(out.groupBy("session_id").agg(
        count(streaming.CALL).alias("kept"), count(streaming.REPEATED).alias("repeated")), "session_id")


@query("stream_late", f"""WITH {W.TELEMETRY_SQL},
d AS (SELECT *, max(CASE WHEN k % 3 > 0 THEN ts END) OVER (PARTITION BY session_id) - INTERVAL '3 days' AS bound FROM tele),
r AS (SELECT session_id, ts, k % 3 = 0 AND bound IS NOT NULL AND ts < bound AS late FROM d)
SELECT session_id, epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000 AS window_start_ms,
  count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late
FROM r GROUP BY ALL""")
def stream_late(spark, sf_dir):
    """Rows per session and day: those counted in their window, and those that came over three days late.

    Every third row lands after the others.
    """
    work = new_shared_path(spark, "late")
    rows = write_shared(W.telemetry(spark, sf_dir).select(
        "session_id", F.col("ts").cast("timestamp").alias("ts"), F.col("ord").alias("call_no"), "k"), "late-rows")
    for late in (False, True):
        part = rows.where((F.col("k") % 3 == 0) == late).select("session_id", "ts", "call_no", F.lit(False).alias("ended"))
        if late:  # a last row ends every session, so that its open windows are told
            ends = rows.select("session_id").distinct().select(
                "session_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("call_no"), F.lit(True).alias("ended"))
            part = part.unionByName(ends).repartition("session_id")  # the END of a session must not come before its rows
        land(part, work)
        landed = stateful_session(spark, stores(spark, f"{work}/landing")).readStream.schema(part.schema).parquet(f"{work}/landing")
        counted = window_counts(landed, "1 day", "3 days")
        streaming.write_totals(counted, f"{work}/out", f"{work}/ckpt", availableNow=True).awaitTermination()
    told = streaming.read_totals(spark, f"{work}/out", counted.schema).where("call_no IS NULL OR call_no >= 0")
    start = F.coalesce("window_start", F.date_trunc("day", "ts")).cast("timestamp_ntz")
    count = lambda which: F.sum(F.when(F.col("what") == which, F.col("rows")).otherwise(0))
    return told.groupBy("session_id", W.epoch_ms(start).alias("window_start_ms")).agg(
        count("window").alias("kept"), count("late").alias("late"))


def _land(spark, rows, name):
    work = new_shared_path(spark, name)
    rows.write.parquet(f"{work}/landing")
    return work


@query("stream_windows", f"""WITH {W.TELEMETRY_SQL}
SELECT session_id, epoch_us(time_bucket(INTERVAL '5 minutes', ts)) // 1000 AS window_start_ms, count(*) AS rows
FROM tele GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Rows per session and five minutes, counted by a stream in update mode.

    Every batch writes the windows it changed. Counts only grow, so the largest is the newest.
    """
    rows = W.telemetry(spark, sf_dir).select("session_id", F.col("ts").cast("timestamp").alias("ts"))
    work = _land(spark, rows, "windows")
    landed = spark.readStream.schema(rows.schema).parquet(f"{work}/landing")
    windows = streaming.chunk_windows(landed, "1 day")
    streaming.write_totals(windows, f"{work}/out", f"{work}/ckpt", mode="update",
                           availableNow=True).awaitTermination()
    newest = (streaming.read_totals(spark, f"{work}/out", windows.schema)
              .groupBy("session_id", "window_start").agg(F.max("rows").alias("rows")))
    return newest.select("session_id", W.epoch_ms(F.col("window_start").cast("timestamp_ntz"))
                         .alias("window_start_ms"), "rows")


@query("stream_deduplicated", f"""WITH {W.STREAM_SQL}
SELECT session_id, tick, rank, kind, name, delta FROM stream""")
def stream_deduplicated(spark, sf_dir):
    """Calls delivered twice and passed on once."""
    rows = landing_rows(W.telemetry(spark, sf_dir)).where(F.col("kind") != "END")
    work = _land(spark, rows.union(rows), "duplicates")
    once = streaming.drop_duplicates(
        streaming.read_closed_chunks(spark, f"{work}/landing"), "1 day")
    streaming.write_totals(once, f"{work}/out", f"{work}/ckpt", availableNow=True).awaitTermination()
    return (streaming.read_totals(spark, f"{work}/out", once.schema)
            .select("session_id", "tick", "rank", "kind", "name", "delta"))
