"""Folders and small files that the driver and all executors see."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name inside the one that spark.checkpoint.dir names; in local mode the warehouse serves where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """Small text files of a folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, sub: str = "") -> dict[str, int]:
        """Names in the folder or a folder of it, with the times of their last change in milliseconds."""
        path = self._path(sub)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(path)} if self.fs.exists(path) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Makes a file appear whole, under a name that nobody has taken; false if somebody has.

        A hard link on a mounted folder and a rename elsewhere refuse a name that exists; on an object store this needs one with conditional writes.
        """
        draft = f"_draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() != "file":
                return not self.fs.exists(self._path(name)) and self.fs.rename(self._path(draft), self._path(name))
            here, there = (self.jvm.java.io.File(self._path(x).toUri().getPath()).toPath() for x in (draft, name))
            try:
                self.jvm.java.nio.file.Files.createLink(there, here)
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                    return False
                raise
        finally:
            self.fs.delete(self._path(draft), True)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
