"""Named collections as Parquet folders with versions: a write adds a version, then a numbered marker that names it.

A marker's file is created under its number, which only one writer can do, so of two writers that began from the
same state one fails with Conflict, and nothing of it is seen. Readers take the version of the highest number: the old
state or the new. Paths go through Hadoop's filesystem: any store will do that can create a file if it isn't there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer changed the collection after it was read."""


class CollectionStore:
    """keep: how many versions before the current one stay, for plans that read them still."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _markers(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.folder}/{name}")
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("current-"))

    def _marker(self, name: str, number: int):
        return self._fs(f"{self.folder}/{name}/current-{number:012d}")

    def _named(self, name: str, number: int) -> str:
        """The version that a marker names, "" if its writer hasn't ended it."""
        fs, p = self._marker(name, number)
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else ""

    def _current(self, name: str) -> tuple[int, str | None]:
        """(number, version) of the collection now; (-1, None) if there is none. A marker whose writer died between
        creating and filling it is passed over after a while."""
        for _ in range(20):
            marks = self._markers(name)
            if not marks:
                return -1, None
            if version := self._named(name, marks[-1]):
                return marks[-1], version
            time.sleep(0.1)
        older = [v for n in reversed(marks[:-1]) if (v := self._named(name, n))]
        return marks[-1], older[0] if older else None

    def exists(self, name: str) -> bool:
        return self._current(name)[1] is not None

    def number(self, name: str) -> int:
        """The number of the state now, to be handed to a write that is computed from what is read after this."""
        return self._current(name)[0]

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The collection now; one that isn't there is empty, with the given schema."""
        version = self._current(name)[1]
        if version is None:
            if schema is None:
                raise ValueError(f"there is no collection {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{name}/{version}")

    def write(self, name: str, df: DataFrame, after: int | None = None) -> None:
        """Replaces the collection, whose state must still be number `after`, if given; else Conflict is raised.

        Readers that began before keep their version until `keep` further writes have been made.
        """
        before = self.number(name) if after is None else after
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}/{version}")
        fs, mark = self._marker(name, before + 1)
        try:
            if self.number(name) != before:
                raise Conflict(f"another writer changed {name}")
            try:
                stream = fs.create(mark, False)
            except Py4JJavaError as e:
                raise Conflict(f"another writer changed {name}") from e
        except Conflict:
            fs.delete(self._fs(f"{self.folder}/{name}/{version}")[1], True)
            raise
        stream.write(bytearray(f"{version}\n".encode()))
        stream.close()
        for old in self._markers(name)[: -1 - self.keep]:
            # The marker goes last: a version without a marker is never found again.
            if gone := self._named(name, old):
                fs.delete(self._fs(f"{self.folder}/{name}/{gone}")[1], True)
            fs.delete(self._marker(name, old)[1], False)

    def update(self, name: str, change: Callable[[], DataFrame | None], tries: int = 5) -> None:
        """Writes what change() computes from the collection, again if another writer came first. None: no write."""
        for left in reversed(range(tries)):
            after = self.number(name)
            if (df := change()) is None:
                return
            try:
                self.write(name, df, after)
                return
            except Conflict:
                if not left:
                    raise

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.delete(p, True)
