"""Datasets with named splits, as hubs lay them out: <path>/<dataset>/<config>/<split>-*.parquet, <split>.parquet or <split>/.

A data source of its own, spark.read.format("hub"): one split by name, its files planned as partitions (large files by row
groups), only the columns asked for read, and an error that names what there is where a split or column is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from skein.session import share_path

#: Bytes of a file that one partition reads, in whole row groups.
PARTITION_BYTES = 128 << 20
BATCH_ROWS = 1000


@dataclass
class Part(InputPartition):
    """Some row groups of a file; all of them if none are named."""

    file: str
    groups: tuple[int, ...] = ()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


def names(text: str | None) -> list[str]:
    return [c.strip() for c in (text or "").split(",") if c.strip()]


class Hub(DataSource):
    """Options: path, dataset, split (train if none), config, columns (all if none), required, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "hub"

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        fs, root = file_system(self.options["path"])
        return fs, "/".join([root.rstrip("/"), *filter(None, (self.options.get("dataset"), self.options.get("config")))])

    def files(self) -> list[pafs.FileInfo]:
        """The split's files in order of name; hidden ones are none."""
        fs, folder = self._folder()
        split = self.options.get("split", "train")
        found: dict[str, list[pafs.FileInfo]] = {}
        for info in fs.get_file_info(pafs.FileSelector(folder, recursive=True)):
            at = info.path[len(folder) :].strip("/").split("/")
            if info.type != pafs.FileType.File or not at[-1].endswith(".parquet") or any(p[0] in "._" for p in at) or len(at) > 2:
                continue
            found.setdefault(at[0] if len(at) == 2 else re.sub(r"(-\d+-of-\d+)?\.parquet$", "", at[0]), []).append(info)
        if split not in found:
            raise ValueError(f"no split {split} in {folder}; there are: {', '.join(sorted(found)) or 'none'}")
        return sorted(found[split], key=lambda i: i.path)

    def schema(self) -> StructType:
        fs, _ = self._folder()
        file = self.files()[0].path
        there = pq.read_schema(file, filesystem=fs)
        wanted = names(self.options.get("columns")) or there.names
        if lost := [c for c in [*wanted, *names(self.options.get("required"))] if c not in there.names]:
            raise ValueError(f"no column {', '.join(lost)} in {file}; there are: {', '.join(there.names)}")
        return from_arrow_schema(pa.schema([there.field(c) for c in wanted]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return HubReader(self, schema)


class HubReader(DataSourceReader):
    def __init__(self, source: Hub, schema: StructType):
        self.source, self.wanted = source, schema

    def partitions(self) -> Sequence[InputPartition]:
        """A partition for each file; a file over the limit is split by its footer, others are not opened."""
        fs, _ = self.source._folder()
        limit, out = int(self.source.options.get("partitionBytes", PARTITION_BYTES)), []
        for info in self.source.files():
            if info.size <= limit:
                out.append(Part(info.path))
                continue
            meta, some, size = pq.read_metadata(info.path, filesystem=fs), [], 0
            for g in range(meta.num_row_groups):
                some.append(g)
                size += meta.row_group(g).total_byte_size
                if size >= limit or g == meta.num_row_groups - 1:
                    out.append(Part(info.path, tuple(some)))
                    some, size = [], 0
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = self.source._folder()
        target = to_arrow_schema(self.wanted)
        with fs.open_input_file(partition.file) as f:
            file = pq.ParquetFile(f)
            if lost := [c for c in target.names if c not in file.schema_arrow.names]:
                raise ValueError(f"no column {', '.join(lost)} in {partition.file}")
            for b in file.iter_batches(BATCH_ROWS, list(partition.groups) or None, columns=target.names):
                yield pa.RecordBatch.from_arrays([b.column(c).cast(target.field(c).type) for c in target.names], schema=target)


def load(spark: SparkSession, path: str, dataset: str, split: str = "train", config: str | None = None, columns: Sequence[str] = (), required: Sequence[str] = (), **more: str) -> DataFrame:
    """A split of a dataset: those columns (all if none are named); it is an error if any of them or of required is missing.

    path may be local or a store that Arrow opens (file:, hdfs:, s3:, gs:). Files keep their order within a partition only.
    """
    share_path(spark)
    spark.dataSource.register(Hub)
    options = {"path": path, "dataset": dataset, "split": split, "config": config, "columns": ",".join(columns), "required": ",".join(required)} | more
    return spark.read.format("hub").options(**{k: v for k, v in options.items() if v}).load()
