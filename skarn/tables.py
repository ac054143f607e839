"""Versioned tables in a folder: appends add files, rewrites make a new version and add a pointer to it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Versions that stay behind the current one, for readers that began before it.
KEEP = 8


class Table:
    """One table with an explicit schema and properties that every opener must agree with. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, properties: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        stamp = json.dumps(properties or {}, sort_keys=True)
        held = self._read("properties.json")
        if held is None:
            self._write("properties.json", stamp)
        elif held != stamp:
            raise ValueError(f"the table at {root} was made with {held}, not {stamp}")

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """A file that was not there before, by rename: a reader sees all of it or none."""
        temporary, path = self._path(f"{self.root}/.{name}.new"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(temporary, path):
            raise OSError(f"could not write {self.root}/{name}")

    def _version(self, n: int) -> str:
        return f"{self.root}/v{n}"

    @property
    def version(self) -> int:
        """The greatest number that a pointer has. Pointers are only added, so there is no moment without one."""
        found = self._fs.globStatus(self._path(f"{self.root}/current-*")) or []
        return max((int(f.getPath().getName().rpartition("-")[2]) for f in found), default=0)

    def read(self) -> DataFrame:
        path = self._version(self.version)
        if not self._fs.exists(self._path(path)):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)

    def earlier(self, column: str) -> set:
        """Values of a column in the versions that stay behind the current one; for tables of few rows."""
        found = self._fs.globStatus(self._path(f"{self.root}/v*")) or []
        paths = [str(f.getPath()) for f in found]
        return {r[0] for r in self.spark.read.schema(self.schema).parquet(*paths).select(column).distinct().collect()} if paths else set()

    def append(self, rows: DataFrame) -> None:
        rows.select(self.schema.names).write.mode("append").parquet(self._version(self.version))

    def rewrite(self, rows: DataFrame) -> None:
        """Replaces the table by rows, which may read the table itself."""
        old = self.version
        rows.select(self.schema.names).write.mode("overwrite").parquet(self._version(old + 1))
        self._write(f"current-{old + 1}", "")
        if old >= KEEP:
            self._fs.delete(self._path(f"{self.root}/current-{old - KEEP}"), False)
            self._fs.delete(self._path(self._version(old - KEEP)), True)
