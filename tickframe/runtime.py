"""Makes this package importable in Python workers."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from tickframe.sinks.shared import shared_folder

_shipped: dict[str, str] = {}


def package_zip() -> bytes:
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            # A fixed time keeps the archive equal for equal sources.
            entry = zipfile.ZipInfo(str(source.relative_to(root.parent)), (2020, 1, 1, 0, 0, 0))
            archive.writestr(entry, source.read_bytes())
    return buffer.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application.

    The archive goes to the shared folder, so executors that join later find it too. Every operator
    that runs Python on the workers calls this; it needs no ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    data = package_zip()
    name = f"tickframe-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tickframe/{name}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        stream = system.create(target, True)
        stream.write(bytearray(data))
        stream.close()
    qualified = system.makeQualified(target).toString()
    context.addPyFile(qualified)
    _shipped[context.applicationId] = qualified
