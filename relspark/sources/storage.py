"""Small files on whatever store Spark reaches, through Hadoop's file system."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Storage:
    """Text files under one root. Creation is atomic and never overwrites."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file by moving a finished one into place; false if the name is taken.

        A rename is exclusive on HDFS. On a local disk it would replace, so a hard link takes its place. On an object
        store neither is: there one writer at a time may create.
        """
        target, aside = self._at(name), self._at(f"_aside/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(aside, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(*(p.toUri().getPath() for p in (aside, target)))
                return True
            return not self._fs.exists(target) and self._fs.rename(aside, target)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(aside, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
