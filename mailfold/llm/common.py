"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Characters of text that one step of a task holds in expanded form; bounds worker memory.
STEP_CHARS = 4_000_000

Rows = dict[str, list]


def map_rows(df: DataFrame, schema: str | StructType, fn: Callable[[Rows], Iterable[Rows]], **renamed: str) -> DataFrame:
    """Apply ``fn`` to column lists of bounded slices of ``df`` inside its own partitions.

    ``renamed`` maps the names ``fn`` sees to columns of ``df``; no other column leaves the
    JVM.  ``fn`` yields one or more tables of output columns for a slice.
    """
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    names = tuple(renamed) or tuple(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = {name: part.column(i).to_pylist() for i, name in enumerate(names)}
                for out in fn(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    picked = df.select(*[df[c].alias(n) for n, c in renamed.items()]) if renamed else df
    return picked.mapInArrow(run, struct)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about STEP_CHARS bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.ones(batch.num_rows, dtype=np.int64)
    for i, field in enumerate(batch.schema):
        if pa.types.is_string(field.type) or pa.types.is_binary(field.type) or pa.types.is_large_string(field.type):
            width = pc.binary_length(batch.column(i))
            sizes += width.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.cumsum(sizes) // STEP_CHARS
    cuts = [0, *(np.nonzero(np.diff(step))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that scatters every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
