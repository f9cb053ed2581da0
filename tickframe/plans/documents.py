"""Manifests, ledgers and indexes written as the recorder writes them, and read back from their files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators import chunks
from tickframe.plans import encoders
from tickframe.plans import workload as W
from tickframe.plans.chunks import _LEDGER, ledger_chunks
from tickframe.plans.registry import query
from tickframe.sinks import tables
from tickframe.sinks.shared import new_shared_path
from tickframe.sources import documents


def _file(document):
    return F.encode(F.to_json(document, {"ignoreNullFields": "false"}), "UTF-8").alias("content")


@query("manifests", f"""{_LEDGER}
SELECT session_id, 'complete' AS status, CAST(session_id AS BIGINT) * 7 AS seed, count(*) AS chunks, count(*) FILTER (uploaded) AS uploaded,
  max(end_tick) AS last_tick FROM ledger GROUP BY ALL""")
def manifests(spark, sf_dir):
    """Session manifests and chunk manifests, which share their file name."""
    placed = ledger_chunks(spark, sf_dir)
    root = new_shared_path(spark, "manifests")
    per_chunk = placed.select("session_id", "chunk_index", _file(F.struct(
        "session_id", "chunk_index", "start_tick", "end_tick", "start_time_ms", "end_time_ms", "uploaded")))
    per_session = placed.groupBy("session_id").agg(F.lit(-1).alias("chunk_index")).select("session_id", "chunk_index", _file(F.struct(
        F.lit(1).alias("schema_version"), F.lit("1.16.1").alias("mc_version"), F.lit("a \"b\"").alias("yarn"), "session_id",
        F.lit("u").alias("player_uuid"), (F.col("session_id").cast("long") * 7).alias("seed"), F.lit("survival").alias("game_mode"),
        F.lit("complete").alias("status"))))
    encoders.write_files(per_chunk.unionByName(per_session), root, "manifest.json")
    found = documents.read_chunk_manifests(spark, root).groupBy("session_id").agg(
        F.count("*").alias("chunks"), F.count_if("uploaded").alias("uploaded"), F.max(F.col("end_tick").cast("long")).alias("last_tick"))
    return documents.read_session_manifests(spark, root).select("session_id", "status", "seed").join(found, "session_id")


@query("ledger_documents", f"""{_LEDGER}
SELECT session_id, chunk_index, CAST(start_tick AS INTEGER) AS start_tick, CAST(end_tick AS INTEGER) AS end_tick, uploaded FROM ledger""")
def ledger_documents(spark, sf_dir):
    """The chunks of every session's ledger file."""
    ledgers = chunks.session_ledger(ledger_chunks(spark, sf_dir))
    root = new_shared_path(spark, "ledgers")
    encoders.write_files(ledgers.select("session_id", F.lit(0).alias("chunk_index"), _file(F.struct(
        "session_id", F.lit("p").alias("player_id"), "started_at_ms", "ended_at_ms", "total_chunks", "chunks"))), root, "session_manifest.json")
    return documents.read_ledger_chunks(spark, root)


@query("chunk_order", f"""{_LEDGER}
SELECT session_id, count(*) AS chunks, string_agg(start_tick, ',' ORDER BY start_tick) AS starts, true AS in_order FROM ledger GROUP BY ALL""")
def chunk_order(spark, sf_dir):
    """A written chunk index: its files follow one another, and so do the rows of each."""
    path = new_shared_path(spark, "chunk-index")
    tables.write_index(ledger_chunks(spark, sf_dir).select("session_id", "start_tick", "end_tick"), path)
    read = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"))
    by_file = read.groupBy("session_id", "file").agg(
        F.count("*").alias("n"), F.min("start_tick").alias("first"), F.max("start_tick").alias("last"), F.collect_list("start_tick").alias("starts"))
    before = F.lag("last").over(Window.partitionBy("session_id").orderBy("first"))
    checked = by_file.withColumn("follows", F.coalesce(before < F.col("first"), F.lit(True)))
    # A ledger's chunks are bounded (see ``session_ledger``), and so is this list.
    starts = F.sort_array(F.flatten(F.collect_list("starts")))
    return checked.groupBy("session_id").agg(
        F.sum("n").alias("chunks"), F.array_join(F.transform(starts, lambda t: t.cast("string")), ",").alias("starts"),
        F.bool_and("follows").alias("in_order"))
