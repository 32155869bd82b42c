"""Python functions over Arrow batches, with this package's code sent to the executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame

_SENT: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def send_code(sc: SparkContext) -> None:
    """Add this package to the files of the application, once; executors may not have it."""
    if sc in _SENT:
        return
    package = Path(__file__).resolve().parent.parent
    place = os.path.join(tempfile.mkdtemp(prefix="labelspark-code-"), "labelspark_code.zip")
    with zipfile.ZipFile(place, "w") as z:
        for file in [package / "__init__.py", *sorted((package / "llm").glob("*.py"))]:
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(place)
    _SENT.add(sc)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str
) -> DataFrame:
    """`df.mapInArrow`; a worker gives Arrow's unused memory back when its partition is done."""
    send_code(df.sparkSession.sparkContext)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, kind)


def batch(kind: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of plain Python or numpy columns."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind
    )
