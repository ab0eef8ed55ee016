"""A stored adaptive histogram that a stream or batches go on filling, also after a stop.

A batch is counted by itself and written as a table of its bins, in a folder of the batch's number; what the
store holds is the sum of its batches by key. A batch written again takes its own place, so a replay changes nothing, and a
folder counts only once it is whole (Spark's _SUCCESS file). When there are many, all so far are added up into one base
table; batches up to the base's number are in it and are not read any more. A stop between any two steps loses
nothing and counts nothing twice. No bins pass through the driver, and no state is kept in the stream.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from binforge.operators import coords

from . import adaptive


class BinStore:
    """A folder, shared by driver and executors, of an adaptive histogram of some columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        told = self._read_rule()
        self.cols, self.rules, self.weights, self.kind = told["cols"], [tuple(r) for r in told["rules"]], told["weights"], told["kind"]

    @staticmethod
    def create(spark: SparkSession, path: str, cols: Sequence[str], widths: Sequence[float], shifts: Sequence[float] | None = None, weights: str | None = None, kind: str | None = None) -> BinStore:
        """A new store; where there is one already it goes on, if it has the same axes. kind: of coords.SYSTEMS, whose axes are then binned."""
        n = len(coords.system(kind).axes) if kind else len(cols)
        shifts = list(shifts or [0.0] * n)
        if not n == len(widths) == len(shifts) or any(w <= 0 for w in widths):
            raise ValueError(f"{n} axes need as many positive widths and shifts")
        told = {"cols": list(cols), "rules": [[float(w), float(s)] for w, s in zip(widths, shifts)], "weights": weights, "kind": kind}
        row = spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1)
        row.write.mode("ignore").text(f"{path.rstrip('/')}/rule")
        store = BinStore(spark, path)
        if {"cols": store.cols, "rules": [list(r) for r in store.rules], "weights": store.weights, "kind": store.kind} != told:
            raise ValueError(f"there is another histogram at {path}")
        return store

    def _read_rule(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/rule").first()[0])

    # --- folders ----------------------------------------------------------------------------------
    def _whole(self, of: str) -> list[int]:
        """Numbers of the finished folders of batches or bases."""
        found = self._fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{of}/*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def _drop(self, folder: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def _state(self) -> tuple[int, list[int]]:
        """The newest base's number, -1 for none, and the batches after it."""
        upto = max(self._whole("bases"), default=-1)
        return upto, [k for k in self._whole("batches") if k > upto]

    def _folders(self) -> list[str]:
        upto, batches = self._state()
        return [*([f"{self.path}/bases/{upto}"] if upto >= 0 else []), *(f"{self.path}/batches/{k}" for k in batches)]

    # --- filling ----------------------------------------------------------------------------------
    def _counted(self, df: DataFrame) -> DataFrame:
        cols = self.cols
        if self.kind:
            df, cols = coords.transformed(df, self.kind, cols, False, [self.weights] if self.weights else [])
        return adaptive._counted(df, cols, self._axes(), self.rules, self.weights)

    def _axes(self) -> list[str]:
        return [""] if len(self.rules) == 1 else [str(i) for i in range(len(self.rules))]

    def put(self, df: DataFrame, batch: int, compact: int = 64) -> None:
        """A batch's values, under its number; a number that was put before is replaced, one that is in the base is left.

        compact: add up when there are so many batches.
        """
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        upto, batches = self._state()
        if batch <= upto:  # a replay of what is in the base
            return
        self._counted(df).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        if len({*batches, batch}) >= compact:
            self.compact()

    def add(self, df: DataFrame) -> int:
        """The next number's batch; gives the number. For one writer at a time."""
        upto, batches = self._state()
        batch = max([upto, *batches]) + 1
        self.put(df, batch)
        return batch

    def compact(self) -> None:
        """All batches so far in one base. What a stopped run left behind is dropped too."""
        upto, batches = self._state()
        if not batches:
            return
        last = batches[-1]
        self.table().write.mode("overwrite").parquet(f"{self.path}/bases/{last}")
        for k in self._whole("bases"):
            if k < last:
                self._drop(f"{self.path}/bases/{k}")
        for k in self._whole("batches"):
            if k <= last:
                self._drop(f"{self.path}/batches/{k}")

    def start(self, stream: DataFrame, checkpoint: str, compact: int = 64, **trigger) -> StreamingQuery:
        """Fills from a stream, from where the checkpoint's run stopped; trigger: as of writeStream.trigger."""
        query = stream.writeStream.foreachBatch(lambda df, number: self.put(df, number, compact)).option("checkpointLocation", checkpoint)
        return (query.trigger(**trigger) if trigger else query).start()

    # --- reading ----------------------------------------------------------------------------------
    def table(self) -> DataFrame:
        """bin, left, right (binI, leftI, rightI in N-D), frequency, error2 of all batches; bins that hold nothing are left out."""
        folders = self._folders()
        kind = "double" if self.weights else "long"
        keys = ", ".join(f"bin{s} long, left{s} double, right{s} double" for s in self._axes())
        schema = f"{keys}, frequency {kind}, error2 double"
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        names = list(coords.system(self.kind).axes) if self.kind else self.cols
        return adaptive._summed([adaptive._told(rows, self.rules, names)], self.rules)
