"""Listings made by tasks, against those of Spark's own file index."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tickframe import schemas as S
from tickframe.sources import documents, listing

COLUMNS = ["session_id", "chunk_index", "path", "length", "modificationTime"]


@pytest.fixture
def tree(tmp_path):
    for place, size in {"session_id=a/chunk_1/log.bin": 3, "session_id=a/chunk_2/log.bin": 0, "session_id=b c/chunk_1/deep/er/log.bin": 9,
                        "log.bin": 2, "session_id=a/other.cap": 4, "session_id=a/.log.bin": 5, "_temporary/log.bin": 6, "_k=1/log.bin": 7,
                        "session_id=a/_log.bin": 8, "plain/chunks/chunk_7/x{1}.cap": 1}.items():
        file = tmp_path / place
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * size)
    return tmp_path


@pytest.mark.parametrize("glob", ["*", "log.bin", "*.cap", "{log,other}.*", "?o[a-g].bin", "none", "x*"])
def test_tasks_find_what_the_index_finds(spark, tree, glob):
    for path in (str(tree), f"{tree}/session_id=*", f"{tree}/log.bin", f"{tree}/missing"):
        own = listing.list_files(spark, path, glob)
        index = listing.read_files(spark, path, glob).drop("content")
        assert own.columns == COLUMNS and own.dtypes == index.dtypes
        assert sorted(map(repr, own.collect())) == sorted(map(repr, index.collect()))


def test_no_file_is_listed_by_the_driver(spark, tree):
    plan = listing.list_files(spark, str(tree), "log.bin")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "MapInArrow" in plan
    found = listing.list_folders(spark, str(tree), "log.bin").where(F.col("folder").endswith("chunk_2"))
    assert found.count() == 1  # its file is empty


def test_documents_are_those_of_the_reader(spark, tmp_path):
    one = '{"session_id": "s", "chunk_index": 1, "start_tick": 2, "uploaded": true, "other": [1]}'
    for n, data in enumerate([one.encode(), f"[{one},\n {one}]".encode(), b"[]", b" \n", b"", b"{broken", one.replace("2", '"x"').encode(),
                              one.replace('"s"', '"é"').encode("utf-16"), b"\xef\xbb\xbf" + one.encode(), b'{"session_id": "\xff"}', b"null"]):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "manifest.json").write_bytes(data)
    shape = S.CHUNK_MANIFEST
    for n in (*(f"d{k}" for k in range(11)), ""):
        want = (spark.read.schema(shape).option("multiLine", "true").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "manifest.json").json(f"{tmp_path}/{n}"))
        own = documents._documents(spark, f"{tmp_path}/{n}", "manifest.json", shape)
        assert own.dtypes == want.dtypes
        assert sorted(map(repr, own.collect())) == sorted(map(repr, want.collect())), n
    text = documents.read_chunk_manifests(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in text  # the reader lists all files on the driver
    with pytest.raises(AnalysisException):
        documents.read_chunk_manifests(spark, f"{tmp_path}/none").collect()
