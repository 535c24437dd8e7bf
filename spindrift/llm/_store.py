"""The shared folder: where tables that cut lineage, and the files of the binary formats, are written.

A cluster names the folder in ``spark.checkpoint.dir``; executors and the driver all see it. Only where
that setting is absent and the master is local (tests, a laptop) is a folder of this process made, and removed at
exit; a cluster without the setting is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors share, one per application."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="spindrift-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        base = f"file://{_own}"
    return f"{base.rstrip('/')}/spindrift-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and a lost
    executor costs nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    for paths in _scopes.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` texts in an Arrow batch: texts are long, and both sides of the pipe hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths that :func:`materialise` writes within, of this thread's work alone. Scopes may nest: the
    outer one holds what the inner one does."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield own
    finally:
        _scopes.reset(token)


def release(spark: SparkSession, paths: list[str], keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete tables that :func:`materialise` wrote, but for those that ``keep`` still reads."""
    files = [f for df in keep for f in df.inputFiles()]
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in files):
            where = hadoop.Path(path)
            where.getFileSystem(conf).delete(where, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI: local, HDFS, S3, GCS or whatever pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Write a file under a name of this attempt and move it into place: a retried or speculative
    task replaces the file by an equal one, and no reader sees half a file."""
    fs_, path = filesystem(uri)
    fs_.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    try:
        with fs_.open_output_stream(part, compression=None) as out:
            write(out)
        if fs_.type_name == "hdfs" and fs_.get_file_info(path).type.name != "NotFound":
            fs_.delete_file(path)
        fs_.move(part, path)
    except BaseException:
        if fs_.get_file_info(part).type.name != "NotFound":
            fs_.delete_file(part)
        raise
