"""Tables in a shared folder that change together, in one step or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _folder(spark: SparkSession, root: str, version: int) -> str | None:
    """What a version's mark names; None for a mark whose writer died before it wrote the name."""
    files, path = _files(spark, root)
    stream = files.open(path(f"{root}/versions/{version:012d}"))
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return name.strip() if name.endswith("\n") else None


def _versions(spark: SparkSession, root: str) -> list[int]:
    files, path = _files(spark, root)
    if not files.exists(path(f"{root}/versions")):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(path(f"{root}/versions")) if s.getPath().getName().isdigit())


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, DataFrame]]:
    """``(version, tables)`` as last published under ``root``; version 0 without tables if nothing was."""
    marks = _versions(spark, root)
    for version in reversed(marks):
        folder = _folder(spark, root, version)
        if folder:
            files, path = _files(spark, root)
            names = [s.getPath().getName() for s in files.listStatus(path(f"{root}/{folder}"))]
            return marks[-1], {n: spark.read.parquet(f"{root}/{folder}/{n}") for n in sorted(names)}
    return (marks[-1] if marks else 0), {}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: int) -> int:
    """Write all ``tables`` and make them current as version ``expected + 1``, which is returned.

    Each goes to a new folder; a mark, created only if nobody has that version yet, then makes
    all of them current at once. A writer that dies earlier leaves the old version current.
    ``RuntimeError`` if another writer has published since ``expected``. The folder's file
    system must create a file exclusively, as HDFS does.
    """
    files, path = _files(spark, root)
    folder = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    newer = [v for v in _versions(spark, root) if v > expected]
    try:
        if newer:
            raise RuntimeError(f"version {newer[-1]} was published after {expected}")
        try:
            stream = files.create(path(f"{root}/versions/{expected + 1:012d}"), False)
        except Exception as e:  # the JVM's FileAlreadyExistsException
            raise RuntimeError(f"version {expected + 1} exists") from e
        try:
            stream.write(bytearray(f"{folder}\n".encode()))
        finally:
            stream.close()
    except RuntimeError:
        files.delete(path(f"{root}/{folder}"), True)
        raise
    return expected + 1
