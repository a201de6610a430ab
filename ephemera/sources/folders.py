"""Folders of a Hadoop file system that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below spark.checkpoint.dir. Where that is unset local mode takes a temporary folder; on a cluster it is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """What a stored table needs of its file system: exclusive creation of empty files, names of entries, deletion."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.system = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self, name: str) -> None:
        self.system.mkdirs(self._at(name))

    def create(self, name: str) -> bool:
        """Makes an empty file, with its folders; False if it is there already. One step: of several writers one succeeds."""
        at = self._at(name)
        self.system.mkdirs(at.getParent())
        try:
            return bool(self.system.createNewFile(at))
        except Exception as e:
            if self.system.exists(at):
                return False
            raise e

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def delete(self, name: str) -> None:
        self.system.delete(self._at(name), True)
