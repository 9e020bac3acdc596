"""Helpers shared by the training-data operators.

Every operator that needs Python runs as one ``mapInArrow`` pass: Spark deals
the rows, the function sees Arrow batches of bounded size, and every input
column passes through untouched.  An output column replaces an input column of
the same name (names compare without case, as in Spark).
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this subpackage travel to the executors with the job, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Texts are handed to an operator's function in slices of about so many bytes.
SLICE_BYTES = 2 << 20

#: A word of the contracts: a run of anything but the blank and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names) -> list[str]:
    """The columns of df whose names don't clash with names."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def byte_slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of about ``limit`` bytes of text; a longer row is a slice of its own."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(col))).fill_null(0).to_numpy()
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, col: str) -> list:
    return batch.column(batch.schema.get_field_index(col)).to_pylist()


def arrow_map(
    df: DataFrame,
    added: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    text_col: str = "text",
    drop: tuple[str, ...] = (),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """df with the columns ``added``.

    ``make()`` runs once a task and returns a function from a batch to
    ``{name: values}``; ``drop`` names input columns that it sees but that aren't passed on.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = without(df, [*added.names, *drop])
    read = [*kept, *dict.fromkeys(c for c in (text_col, *drop) if c not in kept and c in df.columns)]
    target = to_arrow_schema(added)
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)

    def run(batches):
        f = make()
        for whole in batches:
            for batch in byte_slices(whole.rename_columns(read), text_col, slice_bytes):
                out = f(batch)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                columns += [out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], x.type) for x in target]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *target.names])

    # numbered on their way, as mapInArrow takes no names with dots
    return df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(read)]).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where none is named, a temporary folder serves on one machine, as in tests; a cluster must name one.
    """
    import tempfile
    import uuid

    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(known or tempfile.mkdtemp(prefix="checkpoint-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{held.get()}/{uuid.uuid4().hex}"


#: Spark's setting by which a finished query's shuffle files go at once.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: dict = {"lock": threading.Lock(), "before": {}}


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Each query of the session cleans its own shuffle files when it ends; after the last of several writes at a time the session's setting is what it was."""
    lock, held = _writing["lock"], _writing["before"]
    name = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
    with lock:
        n, before = held.get(name, (0, spark.conf.get(CLEAN_SHUFFLES, "false")))
        held[name] = (n + 1, before)
        spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        with lock:
            n, before = held.pop(name)
            if n > 1:
                held[name] = (n - 1, before)
            else:
                spark.conf.set(CLEAN_SHUFFLES, before)


def stored(df: DataFrame, name: str = "part", of: list | None = None) -> DataFrame:
    """df written once to the shared folder and read back: lost executors don't undo it, and it's computed once.

    The write's shuffle files aren't read again, so they go with it.  ``of`` gets the table, for ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    with clean_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if of is not None:
        of.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Words:
    """The words of many texts in one buffer, each followed by one blank.

    ``text``: the buffer; ``begin``, ``length``: where each word stands in it, in bytes; ``sizes``: words of each text.
    """

    def __init__(self, column: pa.Array):
        import numpy as np

        parts = column.cast(pa.binary()).to_pylist()
        raw = np.frombuffer(b"\n".join([p or b"" for p in parts]) + b"\n", np.uint8)
        blank = np.zeros(256, bool)
        blank[[32, *range(9, 14)]] = True
        word = ~blank[raw]
        edges = np.flatnonzero(np.diff(word, prepend=False))
        starts, self.length = edges[::2], edges[1::2] - edges[::2]
        ends = np.cumsum(np.array([len(p or b"") + 1 for p in parts], np.int64))
        self.sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
        keep = word.copy()
        keep[1:] |= word[:-1]
        buffer = raw[keep]
        buffer[~word[keep]] = 32
        self.begin = np.cumsum(self.length + 1) - (self.length + 1)
        self.buffer, self.text = buffer, buffer.tobytes()

    def spans(self, first, last) -> list[bytes]:
        """The words first .. last - 1 of the buffer, joined by single blanks, for arrays of both; empty where there are none."""
        import numpy as np

        end = np.r_[self.begin, len(self.text)]
        text = self.text
        return [text[a:z] if z > a else b"" for a, z in zip(end[first].tolist(), (end[last] - 1).tolist())]

    def joined(self) -> list[bytes]:
        """The words of each text, joined by single blanks."""
        import numpy as np

        last = np.cumsum(self.sizes)
        return self.spans(last - self.sizes, last)

    def hashes(self, chunk: int = 1 << 18):
        """64-bit hashes of all words: polynomials of their bytes, by prefix sums over chunks of whole words."""
        import numpy as np

        n, out, i = len(self.begin), np.empty(len(self.begin), np.uint64), 0
        while i < n:
            a = self.begin[i]
            j = max(i + 1, int(np.searchsorted(self.begin, a + chunk)))
            z = self.begin[j - 1] + self.length[j - 1]
            up, down = _powers(int(z - a))
            sums = np.zeros(z - a + 1, np.uint64)
            np.cumsum((self.buffer[a:z].astype(np.uint64) + np.uint64(1)) * up[: z - a], out=sums[1:])
            at = self.begin[i:j] - a
            out[i:j] = (sums[at + self.length[i:j]] - sums[at]) * down[at]
            i = j
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


#: An odd number and its inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93
_tables: list = []


def _powers(n: int):
    """Powers of the base and of its inverse, n at least."""
    import numpy as np

    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            _tables[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables
