"""The folder that driver and executors share, for checkpoints and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all runs on this machine, else an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(context.applicationId)
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new URI below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Store:
    """Small files and folders of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.base = base.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Whole or not at all; a name that is taken is an error."""
        part = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(text.encode())
        stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(part, self._path(name)):
            self.fs.delete(part, False)
            raise FileExistsError(f"{self.base}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
