"""Entity, position, upload and ledger checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import edges, quality
from tickframe.plans import workload as W
from tickframe.plans.registry import query
from tickframe.sinks import tables
from tickframe.sinks.shared import new_shared_path

_T = f"WITH {W.TELEMETRY_SQL}"


@query("entity_kills", """SELECT l_orderkey, l_partkey AS entity_id, p_type AS entity_type
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 3 AND p_size <= 40""")
def entity_kills(spark, sf_dir):
    """Large parts are entities the client does not know."""
    statuses = W.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("status"))
    known = W.table(spark, sf_dir, "part").where(F.col("p_size") <= 40).select(
        F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"))
    return quality.entity_kills(statuses, known).select("l_orderkey", "entity_id", "entity_type")


_ERRORS = """WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 30 AS x,
  CAST(embedding[2] AS DOUBLE) * 30 AS y, CAST(embedding[3] AS DOUBLE) * 30 AS z FROM embeddings),
errors AS (SELECT CAST(r.label AS VARCHAR) AS session_id, r.vec_id AS tick,
  sqrt(pow(p.x - r.x, 2) + pow(p.y - r.y, 2) + pow(p.z - r.z, 2)) AS pos_error
  FROM v r JOIN v p ON p.vec_id = r.vec_id + 1)"""


def _errors(spark, sf_dir):
    """The vector of the next id stands for the predicted position of a tick."""
    at = lambda i: (F.col("embedding")[i].cast("double") * 30)
    vectors = W.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    recorded = vectors.select(F.col("label").cast("string").alias("session_id"),
                              F.col("vec_id").alias("tick"), "x", "y", "z")
    owner = recorded.select("session_id", "tick")
    predicted = (vectors.select((F.col("vec_id") - 1).alias("tick"), "x", "y", "z")
                 .join(owner, "tick"))
    return quality.position_errors(predicted, recorded)


@query("position_error", f"{_ERRORS} SELECT session_id, tick, round(pos_error, 6) AS pos_error FROM errors")
def position_error(spark, sf_dir):
    return _errors(spark, sf_dir).withColumn("pos_error", F.round("pos_error", 6))


@query("position_report", f"""{_ERRORS} SELECT session_id, count(*) AS ticks, round(avg(pos_error), 6) AS avg_error,
avg(pos_error) > 5.0 AS alert FROM errors GROUP BY session_id""")
def position_report(spark, sf_dir):
    return quality.error_report(_errors(spark, sf_dir)).withColumn(
        "avg_error", F.round("avg_error", 6))


_FILES = """WITH present AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS session_id, l_linenumber // 4 AS chunk_index,
  CASE l_returnflag WHEN 'A' THEN 'tick_stream.parquet' WHEN 'N' THEN 'events.parquet'
    ELSE 'manifest.json' END AS file FROM lineitem),
chunks AS (SELECT DISTINCT session_id, chunk_index FROM present)"""


def _present(spark, sf_dir):
    flag = F.col("l_returnflag")
    return W.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.call_function("div", F.col("l_linenumber"), F.lit(4)).alias("chunk_index"),
        F.when(flag == "A", "tick_stream.parquet").when(flag == "N", "events.parquet")
        .otherwise("manifest.json").alias("file"))


@query("upload_gaps", f"""{_FILES} SELECT session_id, CAST(chunk_index AS BIGINT) AS chunk_index, file FROM chunks,
  unnest(['tick_stream.parquet', 'events.parquet', 'manifest.json']) AS f(file)
EXCEPT SELECT session_id, CAST(chunk_index AS BIGINT), file FROM present""")
def upload_gaps(spark, sf_dir):
    present = _present(spark, sf_dir)
    return quality.missing_files(present.select("session_id", "chunk_index").distinct(), present)


@query("upload_ready", f"""{_FILES} SELECT session_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM present
GROUP BY session_id, chunk_index HAVING count(*) = 3""")
def upload_ready(spark, sf_dir):
    present = _present(spark, sf_dir)
    return quality.ready_chunks(present.select("session_id", "chunk_index").distinct(), present)


@query("not_uploaded", """SELECT o_custkey AS session_id, o_orderkey AS chunk_index FROM orders
WHERE o_orderstatus <> 'F'""")
def not_uploaded(spark, sf_dir):
    ledger = W.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("chunk_index"),
        (F.col("o_orderstatus") == "F").alias("uploaded"))
    return quality.not_uploaded(ledger).drop("uploaded")


# Chunks of four ticks, known only from some of their rows, so that ticks are missing between them.
_HOLES = f"""{_T},
c AS (SELECT session_id, tick // 4 AS chunk_index, min(tick) AS start_tick, max(tick) AS end_tick
      FROM tele WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)"""


def _holed(spark, sf_dir):
    seen = W.telemetry(spark, sf_dir).where(F.col("event_type").isin("view", "click", "purchase"))
    return edges.add_chunk(seen, 4).groupBy("session_id", "chunk_index").agg(
        F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"))


@query("ledger_gaps", f"""{_HOLES} SELECT session_id, CAST(chunk_index AS INTEGER) AS chunk_index, start_tick, expected_start,
start_tick - expected_start AS gap FROM (SELECT *, coalesce(lag(end_tick) OVER (
  PARTITION BY session_id ORDER BY chunk_index) + 1, 0) AS expected_start FROM c)
WHERE start_tick <> expected_start""")
def ledger_gaps(spark, sf_dir):
    return quality.ledger_gaps(_holed(spark, sf_dir))


@query("ledger_ends", f"""{_HOLES} SELECT session_id, CAST(chunk_index AS INTEGER) AS chunk_index, start_tick,
end_tick - CASE WHEN chunk_index = max(chunk_index) OVER (PARTITION BY session_id) THEN 1 ELSE 0 END AS end_tick
FROM c""")
def ledger_ends(spark, sf_dir):
    """The last chunk of a finished session counts its end one past the last tick."""
    return quality.normalise_ends(_holed(spark, sf_dir))


@query("ledger_state", """SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS chunk_index,
o_orderkey AS start_tick, o_orderkey + 399 AS end_tick, o_orderstatus = 'F' AS uploaded FROM orders""")
def ledger_state(spark, sf_dir):
    """Status rows appended twice: closed, then uploaded; the newest state is read back."""
    closed = W.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("chunk_index"),
        F.col("o_orderkey").alias("start_tick"), (F.col("o_orderkey") + 399).alias("end_tick"),
        F.lit(False).alias("uploaded"), F.col("o_orderdate").alias("updated_at"), "o_orderstatus")
    uploaded = closed.where(F.col("o_orderstatus") == "F").select(
        "session_id", "chunk_index", "start_tick", "end_tick", F.lit(True).alias("uploaded"),
        (F.col("updated_at") + F.expr("interval 1 day")).alias("updated_at"))
    path = new_shared_path(spark, "ledger")
    tables.write_status(closed.drop("o_orderstatus"), path)
    tables.write_status(uploaded, path)
    return tables.current_chunks(spark.read.schema(uploaded.schema).parquet(path))


@query("session_status", """SELECT CAST(o_custkey AS VARCHAR) AS session_id,
arg_max(CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'in_progress' END, o_orderkey) AS status
FROM orders GROUP BY ALL""")
def session_status(spark, sf_dir):
    status = W.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", "complete").otherwise("in_progress").alias("status"),
        F.col("o_orderkey").alias("updated_at"))
    return tables.current_sessions(status).select("session_id", "status")


@query("session_enrichment", """SELECT CAST(o_orderkey AS VARCHAR) AS run, c_name AS player, c_mktsegment AS game_mode
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def session_enrichment(spark, sf_dir):
    """Runs with the manifest of their session; a run without one keeps nulls."""
    found = W.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run"), F.col("o_custkey").alias("session_id"))
    manifests = W.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("session_id"), F.col("c_name").alias("player"),
        F.col("c_mktsegment").alias("game_mode"))
    return quality.with_manifest(found, manifests).select("run", "player", "game_mode")


@query("tick_mismatches", f"""{_T} SELECT session_id, ord AS tick, ord + CAST(k % 5 = 0 AS INTEGER) AS recorded_tick
FROM tele WHERE k % 5 = 0""")
def tick_mismatches(spark, sf_dir):
    shift = F.when(F.col("k") % 5 == 0, 1).otherwise(0)
    return quality.tick_mismatches(W.telemetry(spark, sf_dir).select(
        "session_id", F.col("ord").alias("tick"), (F.col("ord") + shift).alias("recorded_tick")))
