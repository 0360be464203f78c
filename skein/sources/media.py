"""Vectors and sounds as files: a writer of one file a row (npy or wav), readers, and a probe that reads headers only."""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from skein.session import share_path
from skein.sources.hub import file_system

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def npy_bytes(values: list[float | None]) -> bytes:
    """A float32 vector as npy; null entries are NaN."""
    out = io.BytesIO()
    np.save(out, np.array(values, np.float32))
    return out.getvalue()


def wav_bytes(samples: list[float | None], rate: int) -> bytes:
    """Mono 16 bit samples from -1 to 1, louder ones cut off, nulls silent."""
    x = np.nan_to_num(np.array(samples, np.float64))
    data = np.round(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", PCM, 1, rate, rate * 2, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class VectorWriter(DataSourceWriter):
    """Each task writes into a folder of its own below _temporary; the commit moves the folders of the tasks that
    succeeded, one move each, and drops the rest; an abort drops them all."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.rate, self.overwrite = options["path"], options.get("kind", "npy"), int(options.get("rate", 16000)), overwrite
        if self.kind not in ("npy", "wav"):
            raise ValueError(f"unknown kind {self.kind}")

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = file_system(self.path)
        folder, files = f"part-{uuid.uuid4().hex}", 0
        for name, values in iterator:
            if name is None or values is None or not re.fullmatch(r"[^/\x00]+", name) or name[0] in "._":
                raise ValueError(f"not a name and a vector: {name!r}")
            if not files:
                fs.create_dir(f"{root}/_temporary/{folder}", recursive=True)
            with fs.open_output_stream(f"{root}/_temporary/{folder}/{name}.{self.kind}") as out:
                out.write(npy_bytes(values) if self.kind == "npy" else wav_bytes(values, self.rate))
            files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if re.fullmatch(r"part-[0-9a-f]{32}", old.base_name):
                    fs.delete_dir(old.path)
        for m in messages:
            if m and m.files:
                fs.move(f"{root}/_temporary/{m.folder}", f"{root}/{m.folder}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")


class Vectors(DataSource):
    """Options: path, kind (npy or wav), rate (of wav). Rows: name, values."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VectorWriter(self.options, overwrite)


def write_vectors(rows: DataFrame, path: str, name: str, values: str, kind: str = "npy", rate: int = 16000, mode: str = "append") -> None:
    """A file <name>.npy or <name>.wav for each row. A null name or vector, or a name that is no file's, fails the job and leaves
    no file. Two rows of one name make two files if they are in different tasks; the last one stays if not."""
    spark = rows.sparkSession
    share_path(spark)
    spark.dataSource.register(Vectors)
    rows.select(F.col(name).cast("string").alias("name"), F.col(values).cast("array<double>").alias("values")).write.format("vectors").options(path=path, kind=kind, rate=rate).mode(mode).save()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """name, values of npy files below a folder; a file that is none has null values."""
    share_path(spark)

    @F.pandas_udf("array<double>")
    def decode(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> np.ndarray | None:
            try:
                return np.load(io.BytesIO(data), allow_pickle=False).astype(float).ravel()
            except (ValueError, EOFError):
                return None

        return content.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name"), decode("content").alias("values"))


def probe_wav(f: io.RawIOBase, size: int) -> tuple[float, int, int, int] | None:
    """Seconds, bits a second, rate, channels of a RIFF wave, from its chunk headers; None if it is none.

    Chunks are padded to even lengths and may come in any order and number; contents are skipped, not read. A data chunk that
    says it is longer than the file (such as 2 ** 32 - 1, as streams write it) ends with the file.
    """
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= size and (form is None or data is None):
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            body = f.read(min(length, 40))
            if len(body) < 16:
                return None
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            data = min(length, size - at - 8)
        at += 8 + length + length % 2
    if form is None or data is None or form[0] not in (PCM, FLOAT, EXTENSIBLE) or not form[2] or not form[3]:
        return None
    return data / form[3], form[3] * 8, form[2], form[1]


def probe(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """path, seconds, bits_per_second, rate, channels of the files that files lists (see sources.files.listing): some reads of a few bytes
    each, whatever a file's size. What is no wave, or can't be opened, has nulls; files of no bytes are not listed by Spark."""
    share_path(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = []
            for name, size in zip(p["path"], p["length"], strict=True):
                try:
                    fs, at = file_system(re.sub(r"^file:/+", "file:///", name))
                    with fs.open_input_file(at) as f:
                        got.append(probe_wav(f, int(size)) or (None,) * 4)
                except (OSError, ValueError, struct.error):
                    got.append((None,) * 4)
            out = pd.DataFrame(got, columns=["seconds", "bits_per_second", "rate", "channels"]).astype({"bits_per_second": "Int64", "rate": "Int64", "channels": "Int64"})
            yield pd.concat([p[["path"]].reset_index(drop=True), out], axis=1)

    return files.select(F.col(path).alias("path"), F.col(length).alias("length")).mapInPandas(run, "path string, seconds double, bits_per_second long, rate long, channels long")


def kbps(bits: Column) -> Column:
    return F.floor(bits / 1000)
