"""Vectors of numbers that tasks add up over their rows, added up over all tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers of a piece; numbers of all tasks together that the driver adds up itself.
PIECE, DIRECT = 4096, 1 << 22
PIECES = "piece int, v binary"


def summed(rows: DataFrame, tasks: int, size: int, add: Callable):
    """The sum of the vectors (of one size) that ``add`` makes of each task's Arrow batches; tasks is the number of partitions of rows.

    Vectors travel in pieces, those of zeros not at all.  Where all tasks' vectors are few numbers they go to the
    driver in one stage; otherwise Spark deals the pieces out and adds them up first, so that the driver gets one vector.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        v = np.asarray(add(batches), float)
        pieces = [(i // PIECE, v[i : i + PIECE]) for i in range(0, size, PIECE)]
        pieces = [(i, x.tobytes()) for i, x in pieces if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], ["piece", "v"])

    def merge(batches):
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held[i] + np.frombuffer(x) if i in held else np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["piece", "v"])

    parts = rows.mapInArrow(run, PIECES)
    if tasks * size > DIRECT:
        parts = parts.repartition("piece").mapInArrow(merge, PIECES)
    got, out = parts.toArrow(), np.zeros(size)
    for i, x in sorted(zip(got.column("piece").to_pylist(), got.column("v").to_pylist())):
        x = np.frombuffer(x)
        out[i * PIECE : i * PIECE + len(x)] += x
    return out
