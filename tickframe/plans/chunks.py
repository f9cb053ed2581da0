"""Chunk layout, indexes, ledgers and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import chunks, edges
from tickframe.plans import workload as W
from tickframe.plans.registry import query
from tickframe.sinks.shared import new_shared_path
from tickframe.sinks.tables import write_by_session, write_chunked
from tickframe.sources.documents import read_session_table
from tickframe.sources.listing import discover_sessions

CHUNK_TICKS = 8
CAPTURE_ROWS = 5

_T = f"WITH {W.TELEMETRY_SQL}"
_CALM = f"""{_T},
calm AS (SELECT session_id, ord, tick, tick // {CHUNK_TICKS} AS chunk_index,
  (row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1) // {CAPTURE_ROWS} AS chunk_no
  FROM tele WHERE event_type <> 'error')"""


def _calm(spark, sf_dir):
    return (W.telemetry(spark, sf_dir).where(F.col("event_type") != "error")
            .select("session_id", "ord", "tick"))


@query("chunk_buckets", f"{_CALM} SELECT session_id, ord, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_no FROM calm")
def chunk_buckets(spark, sf_dir):
    """Chunks aligned at tick 0, and chunks that close after a number of rows."""
    placed = chunks.positional_chunks(_calm(spark, sf_dir), CAPTURE_ROWS, order="ord")
    return edges.add_chunk(placed, CHUNK_TICKS).select("session_id", "ord", "chunk_index", "chunk_no")


_INDEX = f"""{_T},
idx AS (SELECT session_id, tick // {CHUNK_TICKS} AS chunk_index, min(tick) AS start_tick,
          max(tick) AS end_tick, count(*) AS tick_count, min(ts) AS first_ts, max(ts) AS last_ts
        FROM tele GROUP BY ALL)"""


def _index(spark, sf_dir):
    placed = edges.add_chunk(W.telemetry(spark, sf_dir), CHUNK_TICKS)
    return chunks.index_of(placed, "chunk_index")


@query("chunk_index", f"""{_INDEX} SELECT session_id, CAST(chunk_index AS INTEGER) AS chunk_index,
start_tick, end_tick, tick_count FROM idx""")
def chunk_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query("rechunk", f"""{_CALM} SELECT session_id, chunk_no, min(tick) AS start_tick, max(tick) AS end_tick,
count(*) AS tick_count FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1)
  // {CAPTURE_ROWS} AS chunk_no FROM (SELECT session_id, ord, tick FROM calm)) GROUP BY ALL""")
def rechunk(spark, sf_dir):
    """Writes the rows in fixed chunks and indexes what was written."""
    rows = _calm(spark, sf_dir)
    ticks = rows.select("session_id", F.col("ord").alias("tick"), F.col("tick").alias("game_tick"))
    path = new_shared_path(spark, "rechunk")
    write_chunked(ticks, path, CAPTURE_ROWS)
    written = spark.read.parquet(path).select("session_id", "chunk_no", F.col("game_tick").alias("tick"))
    return chunks.index_of(written, "chunk_no")


@query("max_tick", f"{_INDEX} SELECT coalesce(max(end_tick), -1) AS max_tick FROM idx")
def max_tick(spark, sf_dir):
    return chunks.max_tick(_index(spark, sf_dir))


@query("chunk_counts", f"""{_INDEX} SELECT session_id, count(*) AS chunks,
CAST(sum(tick_count) AS BIGINT) AS ticks FROM idx GROUP BY ALL""")
def chunk_counts(spark, sf_dir):
    return chunks.chunk_counts(_index(spark, sf_dir))


# Every second chunk reaches two ticks into the next one, so some ticks lie in two chunks.
_OVERLAPPING = f"""{_INDEX},
files AS (SELECT session_id, 'chunk_' || chunk_index || '.cap' AS path, start_tick,
  end_tick + CASE WHEN chunk_index % 2 = 0 THEN 2 ELSE 0 END AS end_tick FROM idx)"""


@query("chunk_lookup", f"""{_OVERLAPPING},
hits AS (SELECT t.session_id, t.ord, t.tick, min(start_tick) AS start_tick, arg_min(path, start_tick) AS path
  FROM tele t JOIN files f ON t.session_id = f.session_id AND t.tick BETWEEN f.start_tick AND f.end_tick
  GROUP BY ALL)
SELECT session_id, ord, tick, path, start_tick, tick - start_tick AS offset_in_chunk FROM hits""")
def chunk_lookup(spark, sf_dir):
    index = _index(spark, sf_dir).select(
        "session_id", F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string"), F.lit(".cap")).alias("path"),
        "start_tick", (F.col("end_tick") + F.when(F.col("chunk_index") % 2 == 0, 2).otherwise(0)).alias("end_tick"))
    points = W.telemetry(spark, sf_dir).select("session_id", "ord", "tick")
    return chunks.lookup_chunk(points, index)


def _only(tick: str):
    """A session of all ticks. A literal would be folded out of the keys and put every window's rows into one task."""
    return F.when(F.col(tick).isNotNull(), F.lit("only"))


@query("chunk_lookup_orders", """WITH files AS (
  SELECT o_orderkey // 400 AS n, min(o_orderkey) AS start_tick, max(o_orderkey) AS end_tick
  FROM orders GROUP BY ALL)
SELECT l_orderkey AS tick, n || '.cap' AS path, count(*) AS rows FROM lineitem
JOIN files ON l_orderkey BETWEEN start_tick AND end_tick GROUP BY ALL""")
def chunk_lookup_orders(spark, sf_dir):
    """One single session: segments, not the session, spread the work."""
    number = F.call_function("div", F.col("o_orderkey"), F.lit(400))
    index = (W.table(spark, sf_dir, "orders").groupBy(number.alias("n"))
             .agg(F.min("o_orderkey").alias("start_tick"), F.max("o_orderkey").alias("end_tick"))
             .select(_only("start_tick").alias("session_id"),
                     F.concat(F.col("n").cast("string"), F.lit(".cap")).alias("path"),
                     "start_tick", "end_tick"))
    points = W.table(spark, sf_dir, "lineitem").select(
        _only("l_orderkey").alias("session_id"), F.col("l_orderkey").alias("tick"))
    return (chunks.lookup_chunk(points, index).groupBy("tick", "path")
            .agg(F.count("*").alias("rows")))


# Every order is a chunk of up to 2,000 ticks, so hundreds of chunks lie over each tick, many with the same start.
@query("chunk_lookup_overlaps", """WITH files AS (
  SELECT o_orderkey % 3 AS session, o_orderkey // 40 * 40 AS start_tick, o_orderkey // 40 * 40 + o_custkey * 7 % 2000 AS end_tick,
    o_custkey % 100 || '.cap' AS path FROM orders),
hits AS (SELECT l_orderkey AS tick, session, min(start_tick) AS start_tick, min((start_tick, path)) AS best, count(*) AS n
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN files ON l_orderkey % 3 = session AND l_orderkey BETWEEN start_tick AND end_tick
  GROUP BY ALL)
SELECT CAST(session AS VARCHAR) AS session_id, tick, best[2] AS path, start_tick, tick - start_tick AS offset_in_chunk FROM hits""")
def chunk_lookup_overlaps(spark, sf_dir):
    """Chunks that overlap by the hundred: they are cut into disjoint ranges before any tick is looked up."""
    start = F.call_function("div", F.col("o_orderkey"), F.lit(40)) * 40
    index = W.table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 3).cast("string").alias("session_id"), start.alias("start_tick"),
        (start + F.col("o_custkey") * 7 % 2000).alias("end_tick"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(".cap")).alias("path"))
    points = W.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 3).cast("string").alias("session_id"), F.col("l_orderkey").alias("tick")).distinct()
    return chunks.lookup_chunk(points, index)


@query("tick_lookup", f"""{_T} SELECT session_id, tick, ord, event_type, value
FROM tele JOIN (SELECT session_id, max(tick) // 2 AS tick FROM tele GROUP BY ALL) USING (session_id, tick)""")
def tick_lookup(spark, sf_dir):
    """The middle tick of every session."""
    tele = W.telemetry(spark, sf_dir)
    wanted = tele.groupBy("session_id").agg(
        F.call_function("div", F.max("tick"), F.lit(2)).alias("tick"))
    return chunks.ticks_at(tele, wanted).select("session_id", "tick", "ord", "event_type", "value")


_LEDGER = f"""{_INDEX},
ledger AS (SELECT session_id, chunk_index, start_tick, end_tick, chunk_index % 3 <> 1 AS uploaded,
  epoch_us(first_ts) // 1000 AS start_time_ms, epoch_us(last_ts) // 1000 AS end_time_ms FROM idx)"""


def ledger_chunks(spark, sf_dir):
    placed = edges.add_chunk(W.telemetry(spark, sf_dir), CHUNK_TICKS)
    return placed.groupBy("session_id", "chunk_index").agg(
        F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"),
        W.epoch_ms(F.min("ts")).alias("start_time_ms"), W.epoch_ms(F.max("ts")).alias("end_time_ms"),
    ).withColumn("uploaded", F.col("chunk_index") % 3 != 1)


@query("session_ledgers", f"""{_LEDGER} SELECT session_id, min(start_time_ms) AS started_at_ms,
max(end_time_ms) AS ended_at_ms, CAST(count(*) AS INTEGER) AS total_chunks,
string_agg(chunk_index || ':' || start_tick || '-' || end_tick || ':' || uploaded, ',' ORDER BY chunk_index) AS chunks
FROM ledger GROUP BY session_id""")
def session_ledgers(spark, sf_dir):
    ledgers = chunks.session_ledger(ledger_chunks(spark, sf_dir))
    text = F.transform("chunks", lambda c: F.concat(
        c["index"].cast("string"), F.lit(":"), c["start_tick"].cast("string"), F.lit("-"),
        c["end_tick"].cast("string"), F.lit(":"), c["uploaded"].cast("string")))
    return ledgers.withColumn("chunks", F.array_join(text, ","))


@query("ledger_chunks", f"""{_LEDGER} SELECT session_id, CAST(chunk_index AS INTEGER) AS chunk_index,
start_tick, end_tick, uploaded FROM ledger""")
def exploded_ledger(spark, sf_dir):
    return chunks.explode_ledger(chunks.session_ledger(ledger_chunks(spark, sf_dir)))


@query("absolute_times", f"{_T} SELECT session_id, ord, epoch_us(ts) // 1000 AS at_ms FROM tele")
def absolute_times(spark, sf_dir):
    """Row clocks restart at each chunk; the chunk manifest's start puts them back in time."""
    placed = edges.add_chunk(W.telemetry(spark, sf_dir), CHUNK_TICKS)
    manifests = ledger_chunks(spark, sf_dir)
    logged = (placed.join(manifests.select("session_id", "chunk_index", "start_time_ms"),
                          ["session_id", "chunk_index"])
              .select("session_id", "chunk_index", "ord",
                      (W.epoch_ms(F.col("ts")) - F.col("start_time_ms")).alias("timestamp_ms")))
    return chunks.absolute_time(logged, manifests).select("session_id", "ord", "at_ms")


@query("latest_sessions", f"""{_T} SELECT session_id, max(ts) AS modified_at FROM tele GROUP BY ALL
ORDER BY modified_at DESC, session_id LIMIT 10""")
def latest_sessions(spark, sf_dir):
    changed = W.telemetry(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("modified_at"))
    return chunks.latest(changed, n=10)


@query("row_preview", f"{_T} SELECT session_id, ord, event_type, value FROM tele WHERE ord < 3")
def row_preview(spark, sf_dir):
    rows = W.telemetry(spark, sf_dir).select("session_id", "ord", "event_type", "value")
    return chunks.preview(rows, ["session_id"], "ord", 3)


@query("sessions_with_chunks", """SELECT CAST(c_custkey AS VARCHAR) AS session_id, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def sessions_with_chunks(spark, sf_dir):
    customers = W.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("session_id"), "c_name")
    index = W.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").cast("string").alias("session_id"))
    return chunks.with_chunks_only(customers, index)


def _session_folders(spark, sf_dir):
    rows = W.telemetry(spark, sf_dir).select("session_id", "tick", "ord", "event_type", "value")
    path = new_shared_path(spark, "sessions")
    write_by_session(rows, path)
    return path, rows.schema


@query("session_table", f"{_T} SELECT session_id, tick, ord, event_type, value FROM tele")
def session_table(spark, sf_dir):
    """Written in one folder per session and read back; ids of digits stay text."""
    path, schema = _session_folders(spark, sf_dir)
    return read_session_table(spark, path, schema).select(
        "session_id", "tick", "ord", "event_type", "value")


@query("discovered_sessions", f"{_T} SELECT DISTINCT session_id FROM tele")
def discovered_sessions(spark, sf_dir):
    """Sessions found by listing files."""
    path, _ = _session_folders(spark, sf_dir)
    return discover_sessions(spark, path, "*.parquet").select("session_id")
