"""An object store seen through Hadoop's file systems: local folders, HDFS, S3 and others alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Objects by key under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def ensure(self) -> None:
        """Makes the folder unless it is there."""
        self._fs.mkdirs(self._path(self.root))

    def address(self, key: str) -> str:
        return f"{self.root}/{key.lstrip('/')}"

    def put_file(self, key: str, local: str) -> str:
        """Copies a local file in; gives its address."""
        self._fs.copyFromLocalFile(False, True, self._path(f"file://{local}"), self._path(self.address(key)))
        return self.address(key)

    def put(self, key: str, content: bytes) -> str:
        out = self._fs.create(self._path(self.address(key)), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return self.address(key)

    def fetch(self, key: str, local: str) -> None:
        """Copies an object to a local file."""
        self._fs.copyToLocalFile(False, self._path(self.address(key)), self._path(f"file://{local}"), True)

    def exists(self, key: str) -> bool:
        return bool(self._fs.exists(self._path(self.address(key))))

    def keys(self) -> list[str]:
        """The keys of all objects."""
        found, out = self._fs.listFiles(self._path(self.root), True), []
        base = self._fs.makeQualified(self._path(self.root)).toString().rstrip("/") + "/"
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(base))
        return sorted(out)
