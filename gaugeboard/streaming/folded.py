"""A table that grows batch by batch and is folded now and then, so that reading it stays cheap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gaugeboard.sources.folders import Folder

#: Batches after which the log is folded into the base.
EVERY = 16


class FoldedLog:
    """Rows of numbered batches under one path.

    ``log/<batch>`` holds the rows of a batch, ``base/<batch>`` all rows up to that batch, folded, and an empty
    file ``current/<batch>`` says that this base counts.  ``fold`` turns rows into fewer rows of the same
    columns and the same meaning; folding twice or piece by piece must not change what they mean.

    * A batch written again replaces itself; one that is folded already is left out.
    * The marker is the one step that switches bases.  Before it the old base and all its batches are in place,
      after it they are no longer read, so a crash in between or a second fold changes nothing.
    * What the marker before the last one needed is deleted; a table read before the last fold can still be
      computed.  So at most ``every`` + 1 folders are read and twice as many kept.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, fold: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.spark, self.schema, self.fold, self.every = spark, schema, fold, every
        self.log, self.base, self.current = (Folder(spark, f"{path.rstrip('/')}/{part}") for part in ("log", "base", "current"))

    @staticmethod
    def _name(batch: int) -> str:
        return f"{batch:019d}"

    def folded_to(self) -> int:
        """The last batch of the current base; -1 without one."""
        return max((int(n) for n in self.current.names()), default=-1)

    def _batches(self, after: int) -> list[int]:
        """Batches written whole."""
        return [int(n) for n in self.log.names() if int(n) > after and self.log.child(n).has("_SUCCESS")]

    def folders(self) -> list[str]:
        """What a reader reads."""
        upto = self.folded_to()
        base = [f"{self.base.path}/{self._name(upto)}"] if upto >= 0 else []
        return base + [f"{self.log.path}/{self._name(b)}" for b in self._batches(upto)]

    def read(self) -> DataFrame:
        """The rows of the base and of the batches since."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def append(self, rows: DataFrame, batch: int) -> None:
        upto = self.folded_to()
        if batch <= upto:
            return
        rows.write.mode("overwrite").parquet(f"{self.log.path}/{self._name(batch)}")
        if len(self._batches(upto)) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Fold all batches into a new base."""
        before = self.folded_to()
        batches = self._batches(before)
        if not batches:
            return
        name = self._name(batches[-1])
        self.fold(self.read()).write.mode("overwrite").parquet(f"{self.base.path}/{name}")
        self.current.mark(name)
        for folder in (self.current, self.base, self.log):
            for old in folder.names():
                if int(old) < before or (folder is self.log and int(old) <= before):
                    folder.delete(old)
