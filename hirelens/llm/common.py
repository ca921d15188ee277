"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from hirelens.session import ensure_checkpoint_dir

#: Rows handed to a Python worker at once, and characters worked on at once inside it.
BATCH_ROWS = 2000
CHUNK_CHARS = 4_000_000


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and reread it.

    Cuts the lineage (a lost executor recomputes nothing before this point) and,
    unlike ``checkpoint()``, stays columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker is handed at once, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def text_of(col: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_text(col: str = "doc_id") -> Column:
    """A document id as text, for hashing; a null id counts as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_hash(col: str = "doc_id") -> Column:
    """64-bit hash of an id, also of a null one."""
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("null")))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text is a range of its own."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > limit:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def append_columns(batch: pa.RecordBatch, **cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *cols.values()], names=[*batch.schema.names, *cols])


def run_starts(lengths: np.ndarray) -> np.ndarray:
    """Offset of each of consecutive runs of the given lengths."""
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def with_fields(schema: StructType, **types: DataType) -> StructType:
    """A new schema; StructType.add would change the DataFrame's own."""
    return StructType([*schema.fields, *(StructField(n, t) for n, t in types.items())])


def word_of(h: Column, bits: int) -> Column:
    """The word of a bit set that a 64-bit hash is noted in."""
    return F.pmod(h, F.lit(bits // 64)).cast("int")


def mask_of(h: Column) -> Column:
    """The two bits of its word that stand for a hash (one, now and then)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 40).cast("int")).bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 50).cast("int")))


def bit_words(hashes: DataFrame, bits: int) -> DataFrame:
    """hashes(hash long) -> (w, v): the words of a set of ``bits`` bits, two bits of one word set for each hash.
    At most ``bits`` / 64 rows, for any input."""
    return hashes.groupBy(word_of(F.col("hash"), bits).alias("w")).agg(F.bit_or(mask_of(F.col("hash"))).alias("v"))


def bit_filter(hashes: DataFrame, bits: int) -> Column:
    """The words as one constant array, for use inside array functions (``may_hold``). It is
    part of the plan's text, so keep it small."""
    array = np.zeros(bits // 64, np.int64)
    for r in bit_words(hashes, bits).collect():  # at most bits / 64 rows
        array[r.w] = r.v
    return F.lit(array)


def may_hold(held: Column, h: Column, bits: int) -> Column:
    """Whether the hash may be one of those of the filter (never false for one that is)."""
    word = F.get(held, word_of(h, bits))
    bit = lambda n: F.call_function("getbit", word, F.pmod(F.shiftright(h, n), F.lit(64)).cast("int")) == 1
    return bit(40) & bit(50)  # the second is asked only if the first is set


def release(spark: SparkSession) -> None:
    """Let go of what earlier work left on the driver. Spark drops broadcasts and shuffles once the driver's
    collector finds them unused, by itself only every half an hour."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of the filters on ids: 131,072 words of 16 bytes at most are broadcast.
ID_BITS = 1 << 23


def mark(df: DataFrame, col: str, ids: DataFrame, name: str, bits: int = ID_BITS) -> DataFrame:
    """``df`` with a boolean column ``name``: whether its id ``col`` may be among ``ids`` (one column). A
    set of bits of fixed size is broadcast, whatever the number of ids; an exact join is to follow for
    the rows marked, the others need none."""
    words = materialize(bit_words(ids.select(id_hash(ids.columns[0]).alias("hash")), bits), "bits").select(F.col("w").alias("__w"), F.col("v").alias("__v"))
    df = df.withColumn("__h", id_hash(col)).withColumn("__k", word_of(F.col("__h"), bits))
    df = df.join(F.broadcast(words), F.col("__k") == F.col("__w"), "left")  # bits / 64 rows at most
    mask = mask_of(F.col("__h"))
    return df.withColumn(name, F.coalesce(F.col("__v").bitwiseAND(mask) == mask, F.lit(False))).drop("__h", "__k", "__w", "__v")
