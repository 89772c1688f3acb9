"""A log of commits in a folder: version after version, each a small JSON file that appears whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class CommitLog:
    """Versions 1, 2, ... under path. A commit writes its content beside the log and renames it to the version's name.

    The rename fails if the name exists, so of two writers of a version one raises Conflict, and a writer that is
    killed before it leaves nothing that a reader sees.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, jvm = spark, path, spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._folder = self._fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._folder.getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._files.mkdirs(self._folder)

    def _name(self, version: int):
        return self._fs.Path(self._folder, f"{version:012}.json")

    def versions(self) -> list[int]:
        """All versions, in order."""
        return sorted(int(s.getPath().getName()[:-5]) for s in self._files.listStatus(self._folder) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] != ".")

    def read(self, version: int) -> dict:
        """What a version was committed with."""
        stream = self._files.open(self._name(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The last version and its content; 0 and nothing before the first."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def commit(self, version: int, content: dict) -> None:
        """Make content the version; it has to follow the latest."""
        beside = self._fs.Path(self._folder, f".{uuid.uuid4().hex}.tmp")
        stream = self._files.create(beside, False)
        stream.write(json.dumps(content, sort_keys=True).encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            if (self.versions() or [0])[-1] != version - 1:
                raise Conflict(f"version {version} does not follow the latest of {self.path}")
            self._context.rename(beside, self._name(version), options)
        except Exception as e:
            self._files.delete(beside, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} of {self.path} exists") from e
            raise
