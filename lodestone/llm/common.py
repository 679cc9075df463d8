"""What the operators share: the cluster's shared folder, written tables and bounded Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch of whole texts, at most; one text that is longer is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20

SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A local master, as in tests, gets a temporary
    one where that is unset; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path named, wherever its file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: The folders of the open `scratch` blocks; tables go to the innermost.
_open: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go to a folder of their own, which is removed at the end: nothing lazy may still read them then."""
    _open.append(new_path(spark, "run"))
    try:
        yield
    finally:
        remove(spark, _open.pop())


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df to a path and reads it again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(df: DataFrame, label: str, thin: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: later stages survive the loss of executors and don't recompute it.

    thin: the rows are few against what they are made from; they are dealt into an eighth of the shuffle's partitions.
    """
    spark = df.sparkSession
    if thin:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    return stored(df, f"{_open[-1]}/{label}-{uuid.uuid4().hex}" if _open else new_path(spark, label))


def text_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of Arrow batches, so that memory of Python workers follows the longest text, not the table.

    The settings are the session's, and stay: Spark reads them when a lazy result is run, which may be long after.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


#: A filter of keys that is broadcast has 2**FILTER_LOG2 bits in words of 64: 2**20 rows of 16 bytes at most, whatever the
#: number of keys. Keys that share a bit with a wanted one pass in vain, so with very many keys more rows pass, and none is lost.
FILTER_LOG2 = 26


def _bit(key: Column) -> Column:
    """The bit of a 64-bit key within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _word(key: Column) -> Column:
    """The word that a key's bit is in."""
    return F.shiftright(key, 6).bitwiseAND(F.lit((1 << (FILTER_LOG2 - 6)) - 1).cast("long"))


def filter_of(keys: DataFrame, key: str, label: str) -> DataFrame:
    """(filter_word, filter_bits): a filter of 64-bit keys, bounded by FILTER_LOG2, so that it may be broadcast."""
    words = keys.groupBy(_word(F.col(key)).alias("filter_word")).agg(F.bit_or(_bit(F.col(key))).alias("filter_bits"))
    return F.broadcast(table(words, label, thin=True))


def hits(key: Column) -> Column:
    """The condition under which a row with this key meets a filter's word: the key's bit is set there."""
    return (_word(key) == F.col("filter_word")) & (F.col("filter_bits").bitwiseAND(_bit(key)) != 0)


def may_have(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key passes a filter: all that are wanted, and as few others as its bits allow."""
    return df.join(wanted, hits(F.col(key)), "left_semi")


def numbered(df: DataFrame, order: list[Column], group: str | None = None, label: str = "numbered") -> DataFrame:
    """df with `rank`, each row's place from 0 on in its group by `order`, and `size`, the group's rows. Nulls are a group.

    Rows are dealt by ranges of (group, order), so that a hot group lies in many partitions; a row's place is its place in
    its partition and what its group has in the partitions before, of which there is one count for each partition and group.
    The rows are written, since a recomputed range partition need not hold the same rows.
    """
    spark = df.sparkSession
    keys = ([F.col(group).asc_nulls_first()] if group else []) + order
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("row_at", F.monotonically_increasing_id())
    rows = table(dealt, label).withColumn("part_at", F.shiftright("row_at", 33))
    by = [F.col(group).alias("part_group")] if group else []
    counts = rows.groupBy(F.col("part_at").alias("part"), *by).agg(F.count(F.lit(1)).alias("n"), F.min("row_at").alias("first_at"))
    whole = Window.partitionBy(*(["part_group"] if group else []))
    told = counts.withColumn("before", F.sum("n").over(whole.orderBy("part")) - F.col("n")).withColumn("size", F.sum("n").over(whole)).drop("n")
    told = table(told, f"{label}-counts", thin=True)
    on = F.col("part_at") == F.col("part")
    if group:
        on &= F.col(group).eqNullSafe(F.col("part_group"))
    out = rows.join(told, on).withColumn("rank", F.col("row_at") - F.col("first_at") + F.col("before"))
    return out.drop("row_at", "part_at", "part", "first_at", "before", *(["part_group"] if group else []))
