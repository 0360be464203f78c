"""Incremental writes: appended JSON lines and an upserted table, by batches that may come again.

A batch goes to folders named by its id, so a batch that is written once more replaces itself. When all of it is there, its id
goes into the ledger, a file for each id that is created whole or not at all; readers look at what the ledger names only.
A batch whose id the ledger has changes nothing. So a stream that dies between a write and its checkpoint, and is then
given the batch again, appends no line twice and counts no row twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Increments:
    """A folder with lines/, rows/ and ledger/. keys name a row; of rows with equal keys the one with the largest order stays
    (nulls the smallest), of rows that tie there any one.

    A row batch rewrites the table of newest rows, a row for each key: for tables such as jobs or hosts, not for events; the
    last two are kept, as a reader may still be on the one before.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    keep: int = 2

    def _fs(self, spark: SparkSession, name: str):  # noqa: ANN202
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _ids(self, spark: SparkSession, folder: str) -> list[int]:
        fs, at = self._fs(spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(?:batch=)?(\d+)", n)))

    def done(self, spark: SparkSession) -> list[int]:
        """Ids of the batches that are there, ascending."""
        return self._ids(spark, "ledger")

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key."""
        named = lambda names: [F.col(f"`{c}`") for c in names]
        last = F.max_by(F.struct(*named(c for c in rows.columns if c not in self.keys)), F.struct(*named(self.order))).alias("_last")
        return rows.groupBy(*named(self.keys)).agg(last).select(*[F.col(f"`{c}`") if c in self.keys else F.col("_last").getField(c).alias(c) for c in rows.columns])

    def write(self, batch: int, rows: DataFrame | None = None, lines: DataFrame | None = None) -> bool:
        """Writes a batch unless the ledger has it; says whether it did. Columns that begin with _ stay out of the lines."""
        spark = (rows if rows is not None else lines).sparkSession
        done = self.done(spark)
        if batch in done:
            return False
        if lines is not None:
            lines.drop(*[c for c in lines.columns if c.startswith("_")]).write.mode("overwrite").json(f"{self.path}/lines/batch={batch}")
        if rows is not None:
            old = self._table(spark, done)
            self.newest(rows if old is None else old.unionByName(rows)).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        fs, entry = self._fs(spark, f"ledger/{batch}")
        fs.create(entry, False).close()
        for b in sorted(set(self._ids(spark, "rows")) & {*done, batch})[: -self.keep]:
            fs.delete(self._fs(spark, f"rows/batch={b}")[1], True)
        return True

    def _table(self, spark: SparkSession, done: list[int]) -> DataFrame | None:
        there = set(self._ids(spark, "rows")) & set(done)
        return spark.read.parquet(f"{self.path}/rows/batch={max(there)}") if there else None

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """The newest row of each key, as of the last batch; None before the first."""
        return self._table(spark, self.done(spark))

    def lines(self, spark: SparkSession, schema: str) -> DataFrame:
        """All lines of all batches, with the number of their batch."""
        there = set(self._ids(spark, "lines")) & set(self.done(spark))
        read = spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/lines")
        return read.json([f"{self.path}/lines/batch={b}" for b in sorted(there)]) if there else spark.createDataFrame([], f"{schema}, batch long")


def progress(lines: DataFrame, line: Column, job: str = "job") -> DataFrame:
    """What training logs report: job, ts, epoch, epochs, step, steps, losses of lines that report any."""
    from skein.operators.ops import parse_log

    return parse_log(lines.withColumn("line", line)).filter("epoch is not null").select(job, "ts", "epoch", "epochs", "step", "steps", "losses")


def follow(stream: DataFrame, sink: Increments, checkpoint: str, rows: Callable[[DataFrame], DataFrame], every: str | None = None) -> None:
    """Runs a stream into sink: its rows as lines, rows(batch) into the table. Until stopped at a pace of every (such as
    10 seconds), else over all that is there."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sink.write(number, rows(batch), batch)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start().awaitTermination()
