"""Narrow Python stages that hold a bounded stretch of their input as Python objects, whatever a batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

STRETCH = 1 << 18  # bytes of text that are worked on at once; a longer text stands alone


def stretches(b: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have at most STRETCH bytes beside the first one's."""
    size = np.full(b.num_rows, 64, np.int64)
    for name in texts:
        size += pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // STRETCH
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield b.slice(a, z - a)


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=names)


def flat_rows(df: DataFrame, keys: list[str], used: list[str], fields: str, fn: Callable[..., Iterable[tuple]]) -> DataFrame:
    """keys and ``fields`` of the rows (tuples) that ``fn`` makes of the values of ``used`` of each row; keys stay Arrow columns."""
    picked = df.select(*keys, *used)
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    made = StructType.fromDDL(fields)
    names, types = [f.name for f in made], [to_arrow_type(f.dataType) for f in made]
    texts = [c for c in used if kinds[c] == "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in stretches(b, texts):
                at, rows = [], []
                for i, values in enumerate(zip(*(s.column(len(keys) + k).to_pylist() for k in range(len(used))), strict=True)):
                    new = list(fn(*values))
                    at += [i] * len(new)
                    rows += new
                if rows:
                    out, index = batch_of(rows, names, types), pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(s.column(k).take(index) for k in range(len(keys))), *out.columns], names=[*keys, *names])

    return picked.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), fields]))
