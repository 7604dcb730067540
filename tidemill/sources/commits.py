"""Small commit files that say which folders of data count.

Data goes to a fresh folder first and its commit file is written last, by a rename that
refuses to replace.  A writer that dies before leaves a folder nobody reads; of two
writers that commit the same number one fails.  The files are a few lines of JSON each,
read and written through Hadoop's file systems, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DIGITS = 12


class CommitConflict(RuntimeError):
    """Another writer has committed this number."""


class CommitLog:
    """Numbered JSON files in one folder; the highest number is the state now."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = path.rstrip("/")

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        folder = self._path()
        fs = self._fs(folder)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def read(self, number: int) -> dict:
        path = self._path(f"{number:0{DIGITS}d}.json")
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict | None]:
        """The highest number and its entry; -1 and None where nothing was committed."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def add(self, number: int, entry: dict) -> None:
        """Commit ``entry`` as ``number``, wholly or not at all."""
        draft = self._path(f"_{uuid.uuid4().hex}")
        final = self._path(f"{number:0{DIGITS}d}.json")
        stream = self._fs(draft).create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode("utf-8")))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs(draft).makeQualified(draft), self._fs(final).makeQualified(final), options)
        except Py4JJavaError as error:
            self._fs(draft).delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise CommitConflict(f"{final} was committed by another writer") from None
            raise


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in ``path``; none where it doesn't exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    return [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]


def delete_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
