"""JSON documents and Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import schemas as S
from tickframe.operators.agents import fill_action
from tickframe.operators.chunks import explode_ledger
from tickframe.runtime import ship_package
from tickframe.sources import ranges
from tickframe.sources.listing import list_files_by_tasks, missing
from tickframe.sources.session_files import read_by_tasks

_CORRUPT = "_corrupt_record"


_BATCH_BYTES = 8 << 20


def _utf8(data: bytes) -> bytes:
    """A document in UTF-8; bytes that are no text become one that does not parse, as they do for Spark's reader."""
    try:
        return data.decode(json.detect_encoding(data)).encode()
    except UnicodeDecodeError:
        return b"{"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, size = [], 0
        for row in batch.to_pylist():
            text = _utf8(ranges.read_range(row["path"], 0, row["length"]))
            if text.strip():
                texts.append(text)
                size += len(text)
            if size >= _BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
                texts, size = [], 0
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])


def _documents(spark: SparkSession, path: str, glob: str, schema: T.StructType) -> DataFrame:
    """The objects of all files: one for each, or those of its array; one that does not parse is a row of nulls.

    Spark's reader would list every file on the driver.
    """
    files = list_files_by_tasks(spark, path, glob)
    if files is not None:
        ship_package(spark)
        tasks = spark.sparkContext.defaultParallelism
        texts = files.select("path", "length").repartition(tasks, "path").mapInArrow(_texts, "text binary")
        parsed = F.from_json(F.col("text").cast("string"), T.ArrayType(schema))
        bad = F.array(F.lit(None).cast(schema))
        return texts.select(F.explode(F.coalesce(parsed, bad)).alias("_d")).select(*[F.col(f"_d.{n}").alias(n) for n in schema.names])
    return (spark.read.schema(schema).option("multiLine", "true")
            .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path))


def read_session_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Session manifests (S7); chunk manifests share the file name but have no schema version."""
    found = _documents(spark, path, "manifest.json", S.SESSION_MANIFEST)
    return found.where(F.col("schema_version").isNotNull())


def read_chunk_manifests(spark: SparkSession, path: str) -> DataFrame:
    found = _documents(spark, path, "manifest.json", S.CHUNK_MANIFEST)
    return found.where(F.col("chunk_index").isNotNull())


def read_session_ledgers(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, "session_manifest.json", S.SESSION_LEDGER)


def read_ledger_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk entry of the session ledgers."""
    return explode_ledger(read_session_ledgers(spark, path))


def read_observations(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Observation messages, one JSON object per line."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(S.OBSERVATION).json(path)


def observation_items(observations: DataFrame) -> DataFrame:
    """One row per inventory entry; an observation without any keeps one row."""
    return (observations.select("*", F.explode_outer("inventory").alias("_item"))
            .select(*[c for c in observations.columns if c != "inventory"],
                    F.col("_item.slot").alias("slot"), F.col("_item.id").alias("item"),
                    F.col("_item.count").alias("count")))


def parse_actions(messages: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Actions from a text column, and the messages that are no action."""
    schema = T.StructType([*S.ACTION.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = messages.select(*messages.columns, F.from_json(
        F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
        .alias("_m"))
    bad = F.col("_m").isNull() | F.col(f"_m.{_CORRUPT}").isNotNull()
    others = [c for c in messages.columns if c != column]
    good = parsed.where(~bad).select(*others, *[F.col(f"_m.{n}").alias(n) for n in S.ACTION.names])
    return fill_action(good), parsed.where(bad).select(*messages.columns)


def read_actions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Action messages, one per line, and the rejected lines."""
    return parse_actions(spark.read.text(path), "value")


def read_session_table(spark: SparkSession, path: str, schema: T.StructType, whole: bool = False) -> DataFrame:
    """Parquet written per session (S12); no rows when the path is not there.

    ``session_id`` comes from the folder name. Declaring it a string keeps Spark from
    reading an all-digit id as a number. Who reads the ``whole`` table has many small sessions listed and read by
    the tasks; without, Spark's index finds the folders that conditions on the session leave.
    """
    fields = [f for f in schema.fields if f.name != "session_id"]
    declared = T.StructType([*fields, T.StructField("session_id", T.StringType())])
    found = read_by_tasks(spark, path, "session_id", declared) if whole else None
    if found is not None:
        return found
    try:
        return spark.read.schema(declared).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return missing(spark, declared)


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Casts foreign Parquet, whose types were inferred by its writer, to the declared schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema],
                     *[c for c in df.columns if c not in schema.names])
