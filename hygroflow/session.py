"""Session settings the plans rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hygroflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a new
    temporary folder, which is remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    kept = spark.conf.get("spark.hygroflow.work.dir", None)
    if not kept:
        kept = tempfile.mkdtemp(prefix="hygroflow-")
        spark.conf.set("spark.hygroflow.work.dir", kept)
    return kept


class Files:
    """The few file operations that Spark's readers and writers do not offer, on any file system Spark knows."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def make(self, path: str) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def entries(self, path: str) -> list[tuple[str, float]]:
        """Names in a folder and the second of their last change; none if there is no such folder."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(where)]

    def names(self, path: str) -> list[str]:
        return [name for name, _ in self.entries(path)]

    def text(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Let a small file appear whole; False if one of that name is there."""
        folder, _, name = path.rpartition("/")
        fs, where = self._at(path)
        _, draft = self._at(f"{folder}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        fail = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(fail, 1)
        options[0] = fail.NONE  # an existing target is an error
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
            context.rename(fs.makeQualified(draft), fs.makeQualified(where), options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def delete_on_exit(self, path: str) -> None:
        """Delete an existing path when the driver ends in order."""
        fs, where = self._at(path)
        fs.deleteOnExit(where)


_WORK: ContextVar[str | None] = ContextVar("hygroflow_work", default=None)


@contextmanager
def working_in(folder: str) -> Iterator[None]:
    """What ``stored`` writes inside goes to ``folder``, so that it can be deleted as one."""
    token = _WORK.set(folder)
    try:
        yield
    finally:
        _WORK.reset(token)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared folder and return a scan of it.

    For results that several later steps read: the work before is done once,
    survives the loss of executors, and the scan has a known size, so Spark
    decides about broadcasting it on facts.  The files go when the driver ends.
    """
    path = f"{_WORK.get() or shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    Files(df.sparkSession).delete_on_exit(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scope:
    """Intermediate tables that several analyses share and that go with the scope.

    The first analysis that asks for a table computes and stores it; the others
    scan it.  Closing the scope deletes its folder, so results must have been
    collected or written by then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            df, path = build(), f"{self.folder}/{name}"
            df.write.parquet(path)
            Files(self.spark).delete_on_exit(path)
            self._tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._tables[name]

    def close(self) -> None:
        self._tables.clear()
        Files(self.spark).delete(self.folder)

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        self.close()
