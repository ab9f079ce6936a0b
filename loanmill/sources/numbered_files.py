"""A folder of small files numbered 1, 2, ...; each number is taken once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class LostRace(RuntimeError):
    """Somebody else has taken the number."""


class NumberedFiles:
    """Files are written elsewhere and moved in whole, so none is ever seen half-written.

    That a number is taken once rests on a rename that refuses to replace a file, as HDFS has it.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name
        self._conf = spark._jsc.hadoopConfiguration()
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = self._hadoop.Path(f"{root}/{name}")
        self._files = self._folder.getFileSystem(self._conf)

    def file(self, number: int) -> str:
        return f"{self.root}/{self.name}/{number:012d}.json"

    def numbers(self) -> list[int]:
        """The numbers taken, rising; the files themselves aren't read."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n[0] not in "._")

    def lines(self, *numbers: int) -> list[str]:
        """The lines of some files, in no order."""
        if not numbers:
            return []
        return [r.value for r in self.spark.read.text([self.file(n) for n in numbers]).collect()]

    def add(self, number: int, text: str) -> None:
        """LostRace where the number is taken."""
        begun = self._hadoop.Path(f"{self.root}/{self.name}_begun/{uuid.uuid4().hex}.json")
        wanted = self._hadoop.Path(self.file(number))
        self._files.mkdirs(self._folder)
        out = self._files.create(begun, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self._hadoop, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        wanted, begun = self._files.makeQualified(wanted), self._files.makeQualified(begun)
        try:
            self._hadoop.FileContext.getFileContext(wanted.toUri(), self._conf).rename(
                begun, wanted, never
            )
        except Py4JJavaError as refused:
            if not self._files.exists(wanted):
                raise
            raise LostRace(f"{self.name} {number} is taken") from refused

    def add_next(self, text: str) -> int:
        """Adds under the first free number, after whatever others add meanwhile."""
        number = (self.numbers() or [0])[-1]
        while True:
            number += 1
            try:
                self.add(number, text)
                return number
            except LostRace:
                continue
