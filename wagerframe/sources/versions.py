"""Tables in versions: data is written aside, and a pointer that is created once makes it current."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder of the file system that driver and executors share, by Hadoop's own client."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path(path)
        self._store = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def names(self) -> list[str]:
        if not self._store.exists(self._at):
            return []
        return sorted(status.getPath().getName() for status in self._store.listStatus(self._at))

    def create(self, name: str, content: str) -> None:
        """A new small file; fails if there is one of that name."""
        stream = self._store.create(self._child(name), False)
        try:
            stream.writeUTF(content)
        finally:
            stream.close()

    def read(self, name: str) -> str:
        stream = self._store.open(self._child(name))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self._store.delete(self._child(name), True)


class VersionedTable:
    """A Parquet table of which readers see one whole version.

    A version's data lies in a folder of its own below ``data``. A file in
    ``versions``, named by its number and created exclusively, points to it: until then nobody
    reads the data, and of two writers of one number only the first succeeds. A
    write that fails half-way leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._data, self._versions = (Folder(spark, f"{self.path}/{name}") for name in ("data", "versions"))

    def current(self) -> int | None:
        names = self._versions.names()
        return int(names[-1]) if names else None

    def _pointer(self, version: int) -> dict:
        return json.loads(self._versions.read(f"{version:012d}"))

    def note(self) -> dict:
        """What the writer of the current version noted; empty without one."""
        version = self.current()
        return {} if version is None else self._pointer(version)["note"]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise ValueError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/data/{self._pointer(version)['folder']}")

    def publish(self, df: DataFrame, replace: bool = False, note: dict | None = None) -> int:
        """Make ``df`` the current version; one that is there already is only followed with ``replace``."""
        before = self.current()
        if before is not None and not replace:
            raise ValueError(f"{self.path} has version {before}; it is only followed by another with replace=True")
        folder, version = uuid.uuid4().hex, 1 if before is None else before + 1
        df.write.parquet(f"{self.path}/data/{folder}")
        self._versions.create(f"{version:012d}", json.dumps({"folder": folder, "note": note or {}}))
        return version

    def drop_old(self, keep: int = 1) -> None:
        """Drop all but the last versions, and data that no version points to; no writer may be at work."""
        names = self._versions.names()
        kept = {self._pointer(int(name))["folder"] for name in names[-keep:]}
        for name in names[:-keep]:
            self._versions.drop(name)
        for folder in set(self._data.names()) - kept:
            self._data.drop(folder)


class BatchLog:
    """What the batches of a stream leave behind, as a snapshot and a short log.

    A batch writes its own folder, so a replay replaces it. Every ``every`` batches
    the snapshot and the log are put through ``merge`` and published as the next
    version of the snapshot, which notes the last batch it holds; folders up to that batch are then
    dropped, and a replay of such a batch changes nothing. Readers take one
    version of the snapshot and the batches behind it.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 50):
        self.spark, self.path, self.merge, self.every = spark, path.rstrip("/"), merge, every
        self.snapshot = VersionedTable(spark, f"{self.path}/snapshot")
        self._log = Folder(spark, f"{self.path}/log")

    def _held(self) -> int:
        return self.snapshot.note().get("upto", -1)

    def _open(self) -> list[int]:
        held = self._held()
        return sorted(b for b in (int(name.split("=")[1]) for name in self._log.names()) if b > held)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self._held():
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        if len(self._open()) >= self.every:
            self.compact()

    def read(self) -> DataFrame:
        """The rows of the snapshot and of the batches behind it, as they are."""
        parts = [f"{self.path}/log/batch={b}" for b in self._open()]
        rows = None if self.snapshot.current() is None else self.snapshot.read()
        if parts:
            log = self.spark.read.parquet(*parts)
            rows = log if rows is None else rows.unionByName(log)
        if rows is None:
            raise ValueError(f"{self.path} holds no batch")
        return rows

    def compact(self) -> None:
        batches = self._open()
        if not batches:
            return
        rows = self.read()
        self.snapshot.publish(rows if self.merge is None else self.merge(rows), replace=True, note={"upto": batches[-1]})
        self.snapshot.drop_old()
        for name in self._log.names():
            if int(name.split("=")[1]) <= batches[-1]:
                self._log.drop(name)
