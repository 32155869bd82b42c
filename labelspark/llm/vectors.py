"""Tables of vectors as packed rows, and their layout in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.tasks import map_batches

#: A vector is whole if it has components, none of them null, NaN or infinite.
_WHOLE = "size({0}) > 0 and forall({0}, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"


def whole_vectors(df: DataFrame, vector: str, id_: str, label: str | None = None) -> DataFrame:
    """(vec_id long, label, v array<double>) of the rows that take part in a search.

    Rows without an id, with a null vector, or with a null or non-finite component are left
    out; so are rows whose number of components differs from the most frequent one (of two
    equally frequent, the smaller), as nothing can be compared with them. Other columns, of
    any name, are not read.
    """
    columns = [F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")]
    if label:
        columns.insert(1, F.col(label).cast("long").alias("label"))
    rows = df.select(*columns).where("vec_id is not null and v is not null").where(_WHOLE.format("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def packed(rows: DataFrame) -> DataFrame:
    """`rows` with v as bytes (little-endian doubles), which tasks read without copying."""
    kept = [c for c in rows.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat, n = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8"), len(lists)
            size = len(flat) // n if n else 0
            bounds = np.arange(n + 1, dtype=np.int32) * (8 * size)
            v = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), v], names=[*kept, "v"])

    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "v") + ", v binary"
    return map_batches(rows.select(*kept, "v"), run, kind)


def matrix(column) -> np.ndarray:
    """Packed vectors of a pandas or Arrow column as the rows of a matrix."""
    raw = [bytes(x) for x in (column.to_pylist() if isinstance(column, pa.Array) else column)]
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1) if raw else np.empty((0, 0))


def groups_of(count: int, size: int) -> int:
    """How many groups of about `size` rows a table of `count` rows is dealt into."""
    return max(1, -(-count // size))


def frame(parts: list[tuple], **columns) -> pd.DataFrame:
    """Parts of result columns put together, with the types named; a single value fills its part."""
    if not parts:
        return pd.DataFrame({c: np.empty(0, dtype=t) for c, t in columns.items()})
    lengths = [max(len(x) for x in part if isinstance(x, np.ndarray)) for part in parts]
    return pd.DataFrame({
        c: np.concatenate([x if isinstance(x, np.ndarray) else np.full(n, x) for x, n in zip(values, lengths)]).astype(t)
        for (c, t), values in zip(columns.items(), zip(*parts))
    })
