"""Readers with declared schemas, and writers."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one if none is named and there's one machine."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(known or tempfile.mkdtemp(prefix="checkpoint-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{held.get()}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: a table between two stages; ``discard`` deletes it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``kept`` once nothing reads them any more; other DataFrames are left alone."""
    for df in tables:
        if getattr(df, "stored_at", None):
            _delete(df.sparkSession, df.stored_at)


def tsv_typed(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Tab-separated text, plain or gzipped, with a declared schema."""
    return spark.read.schema(schema).csv(path, sep="\t", header=header)


BED = T.StructType().add("chr", "string").add("chr_start", "long").add("chr_end", "long").add("reason", "string").add("name1", "string").add("name2", "string")


def bed_intervals(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Intervals on numbered chromosomes; header drops the first line."""
    rows = tsv_typed(spark, path, BED, header)
    number = F.regexp_replace("chr", "^chr", "").try_cast("int")
    return rows.withColumn("chr", number).where("chr IS NOT NULL").select("chr", "chr_start", "chr_end", "reason")


def sample_tables(spark: SparkSession, root: str, kind: str, samples: list[str]) -> DataFrame:
    """Tables kind/sample=... of the given samples as one, with the sample's name."""
    return spark.read.option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}").where(F.col("sample").isin(*samples))


def _as_text(t: T.DataType) -> T.DataType:
    """The type with text in place of every number, so that a number may also be written as text."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_as_text(t.elementType))
    return T.StringType() if isinstance(t, T.NumericType) else t


def _typed(c: Column, t: T.DataType) -> Column:
    """A column read by ``_as_text`` in its declared type; null where a text is no such number."""
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_typed(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _typed(x, t.elementType))
    if isinstance(t, T.IntegralType):
        # whole numbers may be written with a fraction of zeros
        x = c.try_cast("double")
        return F.coalesce(c.try_cast(t), F.when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.cast("long").cast("string").try_cast(t)))
    return c.try_cast(t) if isinstance(t, T.NumericType) else c


def _wrong(c: Column, t: T.DataType) -> Column:
    """Whether a column read by ``_as_text`` holds, at any depth, a text that isn't a number of its declared type."""
    if isinstance(t, T.StructType):
        return F.coalesce(reduce(lambda a, b: a | b, [_wrong(c[f.name], f.dataType) for f in t.fields], F.lit(False)), F.lit(False))
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: _wrong(x, t.elementType)), F.lit(False))
    return c.isNotNull() & _typed(c, t).isNull() if isinstance(t, T.NumericType) else F.lit(False)


#: The column of a line that couldn't be read.
BROKEN = "_corrupt_record"


def _ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines as text: ``line``, its fields in ``row`` by ``_as_text``, and ``broken``."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    asked = _as_text(schema).add(BROKEN, "string")
    rows = lines.select(F.col("value").alias("line"), F.from_json("value", asked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("row"))
    return rows.withColumn("broken", F.coalesce(F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull() | _wrong(F.col("row"), schema), F.lit(True)))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of newline-separated JSON, plain or as an export writes it, with numbers as text; broken lines are left to ``broken_ndjson``.

    Every line that isn't blank is in exactly one of the two.
    """
    rows = _ndjson(spark, path, schema).where(~F.col("broken"))
    return rows.select(*[_typed(F.col("row")[f.name], f.dataType).alias(f.name) for f in schema.fields])


def broken_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """file, line of what isn't JSON, or has text where a number of the schema belongs."""
    rows = _ndjson(spark, path, schema).withColumn("file", F.input_file_name())
    return rows.where("broken").select("file", "line")


def write_ndjson(df: DataFrame, path: str, if_exists: str = "skip") -> None:
    df.write.mode({"skip": "ignore", "overwrite": "overwrite"}[if_exists]).json(path)


#: Rows that a folder of ``replace_table`` holds on average, at least.
FOLDER_ROWS = 1 << 18


def replace_table(df: DataFrame, path: str, partition: str, sort: list[str]) -> None:
    """One table in place of another, in folders by a coarse key of whole numbers; each task holds a range of it, sorted.

    A folder (column ``{partition}_from``, the first key that may be in it) is a range of keys: one key, or as many as make
    ``FOLDER_ROWS`` rows on average, so that folders follow the rows and not the number of keys.  df is read three times
    (to count it, for the bounds of the tasks, to write it): one that is costly to compute should be ``kept``.
    """
    rows, lo, hi = df.agg(F.count("*"), F.min(partition), F.max(partition)).first()
    keys = 0 if lo is None else hi - lo + 1
    width = max(1, min(keys, -(-keys * FOLDER_ROWS // max(rows, 1))))
    folder = f"{partition}_from"
    ranged = df.repartitionByRange(partition, *sort).withColumn(folder, F.col(partition) - F.pmod(partition, F.lit(width)))
    ranged.sortWithinPartitions(folder, partition, *sort).write.mode("overwrite").partitionBy(folder).parquet(path)


def append_table(df: DataFrame, path: str, run: str) -> None:
    """Rows of one run added to a table, in a folder of their own (column run_id): a second try of the same run replaces the first."""
    df.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``append_table`` writes, run ids as text."""
    known = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([*[f for f in known if f.name != "run_id"], T.StructField("run_id", T.StringType())])).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None, name: str | None = None) -> DataFrame:
    """df as a table in buckets by keys, each sorted by them: groupings by the keys (and more) and joins on them need no exchange.

    ``buckets`` is the number of shuffle partitions by default; tables that are joined need the same number.  The table is
    an external one in the shared folder; ``drop_bucketed`` takes it away.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"bucketed_{uuid.uuid4().hex}"
    spread = df.repartition(n, *keys)
    spread.write.bucketBy(n, *keys).sortBy(*keys).format("parquet").option("path", scratch(spark)).mode("overwrite").saveAsTable(name)
    out = spark.table(name)
    out.table_name = name
    return out


def drop_bucketed(df: DataFrame) -> None:
    """Takes a table of ``bucketed`` out of the catalog and deletes its files, once nothing reads it any more."""
    spark = df.sparkSession
    where = spark.sql(f"DESCRIBE FORMATTED {df.table_name}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {df.table_name}")
    _delete(spark, where)


def array_text(df: DataFrame, col: str, elem: str = "double", to: str = "array") -> DataFrame:
    """A list column between its quoted text and a native array."""
    c = F.from_json(F.col(col), f"array<{elem}>") if to == "array" else F.to_json(F.col(col))
    return df.withColumn(col, c)
