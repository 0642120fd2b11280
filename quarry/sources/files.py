"""Small files and folders of any Hadoop file system: local paths, file://, hdfs://, s3a:// and the like."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """What a catalog needs of a folder: whole small files, lists, sizes, removal."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def folders(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory())

    def size(self, name: str) -> int:
        """Bytes of a folder or file."""
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Writes beside and renames; the old file is there until the new one is whole, and `latest` finds that one."""
        new, old = self._path(name + ".new"), self._path(name)
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self._fs.delete(old, False)
        self._fs.rename(new, old)

    def latest(self, name: str) -> dict | None:
        """The file, or the one that was to replace it when its writer was lost; None if there is neither."""
        for n in (name, name + ".new"):
            if self.exists(n):
                return self.read(n)
        return None
