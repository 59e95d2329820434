"""Numbers and running sums over a whole table, without a window over all its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import free, written

#: Bits of a row's number within its partition, as in monotonically_increasing_id.
BITS = 33


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table with column ``name``: distinct longs, which stay what they are however the table is read."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def dense(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table with column ``name``: longs from 0 on without a gap.

    Offsets of the partitions are a row a partition, which is all that is broadcast.
    """
    raw, part, offset = (free(df, x) for x in ("raw_number", "number_part", "number_offset"))
    rows = numbered(df, raw).withColumn(part, F.shiftright(raw, BITS))
    sizes = rows.groupBy(part).agg(F.count("*").alias(offset))
    before = F.sum(offset).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select(part, F.coalesce(before, F.lit(0)).alias(offset)))
    number = F.col(offset) + F.col(raw).bitwiseAND(F.lit((1 << BITS) - 1))
    return rows.join(offsets, part).select(*df.columns, number.alias(name))


def running_sum(df: DataFrame, value: str, by: list[str], order: list[Column], name: str = "before") -> DataFrame:
    """``df`` with column ``name``: the sum of the longs in ``value`` over the rows of the same ``by`` columns in front of a row.

    ``by`` has no nulls and leads the order; equal rows in ``order`` count one after another. Rows are dealt out by ranges of
    ``by`` and ``order`` over many tasks, each of which sums up its own; the sums of the tasks,
    a row for each task and group in it, give what lies in front of them. So a group of any
    size is spread over tasks, unless its rows are all equal in ``order``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    part, local, total = (free(df, x) for x in ("range_part", "range_sum", "range_total"))
    keys, at = [df.columns.index(c) for c in by], df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, carried = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.zeros(b.num_rows, bool)  # whether a row starts a group
            for k in keys:
                c = b.column(k)
                first[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            first[0] = tuple(b.column(k)[0].as_py() for k in keys) != last
            sums = np.cumsum(values) - values
            place = np.arange(b.num_rows)
            sums -= sums[np.maximum.accumulate(np.where(first, place, 0))]
            if not first[0]:
                sums[: first.argmax() if first.any() else None] += carried
            last, carried = tuple(b.column(k)[-1].as_py() for k in keys), int(sums[-1] + values[-1])
            told = [*b.columns, pa.array(np.full(b.num_rows, own), pa.int32()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(told, [*b.schema.names, part, local])

    schema = StructType([*df.schema.fields, StructField(part, IntegerType()), StructField(local, LongType())])
    rows = written(ranked.mapInArrow(run, schema))
    sums = rows.groupBy(*by, part).agg(F.sum(value).alias(total))
    before = F.sum(total).over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*by, part, F.coalesce(before, F.lit(0)).alias(total))
    return rows.join(offsets, [*by, part]).select(*df.columns, (F.col(local) + F.col(total)).alias(name))
