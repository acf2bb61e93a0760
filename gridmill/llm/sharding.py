"""Shards of near equal bytes: a table in one order, cut where the bytes before a row pass equal targets.

Rows are range-partitioned by their order and summed up inside each part. The parts' totals, one row
a part, give what lies before each; the shard of a row follows from the bytes before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from gridmill.llm.common import named, per_batch, private, saved

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def size_of(text: Column) -> Column:
    """Bytes of a text in UTF-8 (null: none) and of the row around it."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def checksum(text: Column) -> Column:
    """CRC-32 of a text's UTF-8 bytes; that of nothing for a null one."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _summed(rows: DataFrame, size: str, order: list[str], names: list[str]) -> DataFrame:
    """rows, written, with the part that each lies in, its place there and the bytes before it there.

    Rows that are alike in all of `order` go by where they were read, so that many copies of one row
    are spread over parts as other rows are."""
    (read,) = private(rows, "read")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*named(order), F.col(read)]
    ordered = rows.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(read)
    at = rows.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n, ends = b.num_rows, before + np.cumsum(b.column(at).to_numpy())
            starts = np.concatenate([[before], ends])[:n]
            more = [np.full(n, part), np.arange(place, place + n), starts]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in more)], [f.name for f in schema])
            place, before = place + n, int(ends[-1]) if n else before

    schema = StructType(list(rows.schema.fields))
    for n in names:
        schema = schema.add(n, LongType())
    return saved(per_batch(ordered, run, schema), "ordered")


def _placed(rows: DataFrame, size: str, order: list[str], shards: int, names: list[str]) -> DataFrame:
    """rows with three columns more: their shard, their slot in it and their place among all rows."""
    shard, slot, place = names
    part, nth, within, earlier, before, whole, first = private(rows, "part", "nth", "within", "earlier", "before", "whole", "first")
    summed = _summed(rows, size, order, [part, nth, within])
    # one row a part, of which there are as many as shuffle partitions
    totals = summed.groupBy(part).agg(F.sum(size).alias(whole), F.count("*").alias(first))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        part, F.coalesce(F.sum(first).over(ahead), F.lit(0)).alias(earlier), F.coalesce(F.sum(whole).over(ahead), F.lit(0)).alias(before),
        F.sum(whole).over(Window.partitionBy()).alias(whole),
    )
    # a row belongs where its middle lies: at (2 * bytes before + size) / (2 * all bytes) of the way
    cut = F.expr(f"cast((2 * ({before} + {within}) + `{size}`) * {shards} div (2 * {whole}) as int)")
    got = summed.join(F.broadcast(saved(starts, "starts")), part)
    got = got.select(*named(rows.columns), cut.alias(shard), (F.col(earlier) + F.col(nth)).alias(place))
    begins = got.groupBy(shard).agg(F.min(place).alias(first)).withColumnRenamed(shard, part)
    got = got.join(F.broadcast(saved(begins, "begins")), F.col(shard) == F.col(part))
    return got.select(*named(rows.columns), shard, (F.col(place) - F.col(first)).alias(slot), place)


def assigned(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document's shard, 0 to shards - 1, by the bytes of all documents before it.

    docs: doc_id, text; other columns are ignored. Documents lie in the order of doc_id (null first),
    then size and checksum; rows that are alike in all three have the same text but for chance and lie
    in any order. A row counts the UTF-8 bytes of its text (null: none) and ROW_BYTES. A document lies
    in the shard that its middle byte falls in, so a shard's bytes are off their target by less than
    the largest document, and a document larger than that may leave shards beside it empty. Slots
    count a shard's documents from 0 without gaps. Fewer documents than shards leave shards empty, an
    empty table gives no rows. Bytes times shards must stay under 2^62.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law `bytes` moves
    documents when the number of shards changes), place (among all documents)."""
    text = F.col("text")
    rows = saved(docs.select("doc_id", size_of(text).alias("size"), checksum(text).alias("text_crc32")), "sizes")
    got = _placed(rows, "size", ["doc_id", "size", "text_crc32"], shards, ["shard", "slot", "place"])
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Writes whole documents as Parquet, a folder shard=<number> for each shard that assigned() names.

    All columns are kept; a column named shard is an error. A shard's rows lie in order of a column `slot`."""
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("documents have a column named shard or slot already")
    size, crc, place = private(docs, "size", "crc", "place")
    rows = docs.withColumn(size, size_of(F.col("text"))).withColumn(crc, checksum(F.col("text")))
    got = _placed(rows, size, ["doc_id", size, crc], shards, ["shard", "slot", place])
    got.select(*named(docs.columns), "shard", "slot").write.partitionBy("shard").parquet(path)
