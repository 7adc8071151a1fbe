"""Small files and renames in any file system that Spark reads, from the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """What lies under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        path = self.at(self.root)
        self.fs = path.getFileSystem(self._conf)
        self._context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else self.fs.getUri(), self._conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if there is no such folder."""
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(path))) if self.exists(path) else []

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def move(self, source: str, target: str, replace: bool = False) -> bool:
        """Rename at once; False if the target is there and must not be replaced."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        self.fs.mkdirs(self.at(target).getParent())
        try:
            self._context.rename(self.at(source), self.at(target), options)
        except Exception as e:
            if not replace and ("FileAlreadyExists" in str(e) or self.exists(target)):
                return False
            raise
        return True

    def text(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str, replace: bool = False) -> bool:
        """A whole file or none; False if it is there and must not be replaced."""
        own = f"{self.root}/_staging/{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(own), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.move(own, path, replace):
            return True
        self.drop(own)
        return False
