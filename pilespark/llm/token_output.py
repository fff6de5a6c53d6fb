"""Token-ID output: Parquet list columns with dictionary-encoded ids, small pages with page indexes, in document order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .pretoken import encoder_of, tokenizer_content

TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
SLICE = 512


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10) -> None:
    """Writes one row per document, ascending by id: its id, the file's part, its start there, its token count and the ids.

    Files follow each other in id order by ``part``. ids are dictionary encoded (a vocabulary's ids are few against the tokens of a
    row group), counts and starts lie in columns of their own, and small pages with min/max indexes let a reader of some documents
    or of the metadata skip the rest. A null or empty text gives the end id alone; equal ids stay as separate rows, in text order.
    Columns other than the two named are not read. Null ids come first.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(tokenizer_content(tokenizer))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = encoder_of(content.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                few = batch.slice(at, SLICE)
                rows = [encoder.packed(x) + end for x in few.column(1).to_pylist()]
                sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
                after = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], after]).astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array(start + after - sizes), pa.array(sizes), ids], names=TOKENS.names)
                start += int(after[-1])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(encode, TOKENS).write.mode("overwrite")
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", "true")
     .option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``: the ids of all documents before. Only the parts' totals are gathered, a row for each file."""
    rows = spark.read.schema(TOKENS).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, from rows of ``read_tokens``."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, cuts = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
