"""What the operators of this folder share: reading tables, the shared scratch folder, tokenizer files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this folder: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of a table, whatever else it has."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def no_null(column: Column | str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strings(column: pa.Array) -> list[str]:
    """The column's strings, made by Arrow at once: ``to_pylist`` goes by a Python object for each value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: The temporary folder of a local session, removed when Python ends.
_own: list[str] = []


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a temporary folder,
    and any other master is an error: a machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tactus-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = _own[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows, written to the shared folder and read back: cuts the lineage and survives lost executors. ``name`` is what
    the folder's name begins with, or a path of ``scratch``."""
    path = name if "/" in name else scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary(name: str) -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Buckets that a group's rows are dealt to for numbering; a group of any size is then sorted in this many pieces.
BUCKETS = 256


def bucket_of(key: Column) -> Column:
    """0 to 255 from the first byte of the key's MD5: the same in every engine and on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int")


def numbered(df: DataFrame, group: str, order: list[Column], name: str, bounded_groups: bool = False) -> DataFrame:
    """``df`` with ``name``: a gapless number from 0 within each ``group``, by ``_bucket`` and then ``order``.

    Each (group, bucket) is sorted by itself and offset by the counts of the buckets before it, so that a group which
    holds most rows is no single task. ``bounded_groups``: the groups are few by a parameter, so their counts
    (groups x 256 rows) may be broadcast.
    """
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    joined = df.withColumn(name, within).join(F.broadcast(offsets) if bounded_groups else offsets, [group, "_bucket"])
    return joined.withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).drop("_offset")
