"""Batches for training: ragged rows as rectangular arrays with masks, a batch at a time.

Rows that carry the number of a batch (of like length, see curate.length_batches) meet by that number; each batch is filled in
Arrow by one mask over all of its cells, so no row is handled by itself and no table is gathered. A batch holds as many
rows as its maker gave it: that bounds a task's memory, whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import share_path


@dataclass(frozen=True)
class Ragged:
    """A column of arrays: what fills it, whether the mask is wanted, and to which multiple its width goes up.

    inner is the width of an entry that is an array itself (a frame of a spectrogram): time is padded, entries are not.
    """

    name: str
    fill: float = 0
    mask: bool = True
    multiple: int = 1
    inner: int = 0


def pad(flat: np.ndarray, lengths: np.ndarray, fill: float, multiple: int = 1, inner: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of lengths, one after the other in flat, as (rows, width[, inner]), and which cells are theirs."""
    width = -(-int(lengths.max(initial=0)) // multiple) * multiple
    mask = np.arange(width) < lengths[:, None]
    out = np.full((len(lengths), width, *([inner] if inner else [])), fill, flat.dtype)
    out[mask] = flat.reshape(-1, inner) if inner else flat
    return out, mask


def _flat(column: pa.ListArray, spec: Ragged) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a column, and each row's length; a null row is an empty one, a null cell the fill."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cells = column.flatten()
    if spec.inner:
        widths = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if (widths != spec.inner).any():
            raise ValueError(f"entries of {spec.name} are not {spec.inner} wide")
        cells = cells.flatten()
    filled = cells.fill_null(pa.scalar(spec.fill, cells.type)) if cells.null_count else cells
    return filled.to_numpy(zero_copy_only=False), lengths


def collate(rows: DataFrame, batch: str, key: str, ragged: list[Ragged], scalars: tuple[str, ...] = ()) -> DataFrame:
    """A row for each batch: batch, rows, keys, and for each ragged column <name> (all cells, row by row), <name>_width,
    <name>_lengths and, if wanted, <name>_mask (1 where a cell is the row's own); scalars as arrays.

    Rows stand in order of key (nulls first) in their batch. A null row is empty, a null cell takes the fill; a batch of empty rows
    has width 0; an empty table has no batches; rows without a batch are left out.
    """
    share_path(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    cell = {r.name: kinds[r.name].removeprefix("array<").removesuffix(">").removeprefix("array<").removesuffix(">") if r.inner else kinds[r.name].removeprefix("array<").removesuffix(">") for r in ragged}
    schema = [f"{batch} {kinds[batch]}", "rows int", f"keys array<{kinds[key]}>"]
    for r in ragged:
        schema += [f"{r.name} array<{cell[r.name]}>", f"{r.name}_width int", f"{r.name}_lengths array<int>"] + [f"{r.name}_mask array<tinyint>"] * r.mask
    schema += [f"{s} array<{kinds[s]}>" for s in scalars]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_blank", "descending"), ("_order", "ascending")]).combine_chunks()
        col = lambda name: t.column(name).combine_chunks()
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        out = {batch: t.column(batch).slice(0, 1).combine_chunks(), "rows": pa.array([t.num_rows], pa.int32()), "keys": whole(col("_order"))}
        for r in ragged:
            flat, lengths = _flat(col(r.name), r)
            cells, mask = pad(flat, lengths, r.fill, r.multiple, r.inner)
            out |= {r.name: whole(pa.array(cells.ravel())), f"{r.name}_width": pa.array([mask.shape[1]], pa.int32()), f"{r.name}_lengths": whole(pa.array(lengths, pa.int32()))}
            if r.mask:
                out[f"{r.name}_mask"] = whole(pa.array(mask.ravel().astype(np.int8)))
        return pa.table(out | {s: whole(col(s)) for s in scalars})

    # the order's own columns, as the key may be one of the others
    taken = rows.filter(F.col(batch).isNotNull()).select(batch, F.col(key).alias("_order"), F.col(key).isNull().alias("_blank"), *[r.name for r in ragged], *scalars)
    return taken.groupBy(batch).applyInArrow(run, ", ".join(schema))
