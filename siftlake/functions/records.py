"""Rows of Arrow batches as Python values, column by column: several times faster than by row or by way of pandas."""

from __future__ import annotations

import pyarrow as pa


def values(column: pa.Array) -> list:
    """The column's values as Python objects; lists of structs become lists of dicts. Children are converted as a whole and cut by offset."""
    kind = column.type
    if not len(column):
        return []  # its buffers may be empty too
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        offsets = column.offsets.to_pylist()
        first, last = offsets[0], offsets[-1]
        items = values(column.values.slice(first, last - first))
        lists = [items[a - first : b - first] for a, b in zip(offsets, offsets[1:])]
        return _with_nulls(lists, column)
    if pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        rows = [dict(zip(names, row)) for row in zip(*map(values, column.flatten()))]
        return _with_nulls(rows, column)
    if column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy().tolist()
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _with_nulls(found: list, column: pa.Array) -> list:
    if column.null_count:
        return [x if valid else None for x, valid in zip(found, column.is_valid().to_pylist())]
    return found


def records(batch: pa.RecordBatch) -> list[dict]:
    """The batch's rows as dicts."""
    names = batch.schema.names
    return [dict(zip(names, row)) for row in zip(*map(values, batch.columns))]


def parts(batch: pa.RecordBatch, rows: int) -> list[pa.RecordBatch]:
    """The batch in slices of so many rows, so that no more of it is held as Python objects at once."""
    return [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)]
