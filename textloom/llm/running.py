"""Running sums within groups of any size, by sorted parts and their offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import stage, unused


def running_sums(df: DataFrame, group: str, order: list[Column], values: list[str], name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df, staged, with each of `values` (long, 0 or more, not null) replaced by its sum over the rows of `group` (long, not
    null) up to the row.

    Rows are dealt by ranges of group and order, so that a group of any size goes over many tasks. Each task adds up what it
    has, batch by batch; rows of a group that lies in several parts then get the totals of the parts before theirs. Of such
    groups there is at most one for each part, so their totals are broadcast.
    """
    part, group_, *before = unused(df, "part", "its_group", *(f"before_{v}" for v in values))
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, sums = TaskContext.get().partitionId(), None, dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            lengths = np.diff(np.r_[starts, n])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for v in values:
                own = columns[v].to_numpy(zero_copy_only=False).astype(np.int64)
                if keys[0] == last:
                    own[0] += sums[v]
                total = np.cumsum(own)
                total -= np.repeat(total[starts] - own[starts], lengths)
                sums[v] = int(total[-1])
                columns[v] = pa.array(total)
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(n, at, dtype=np.int32))], names=[*columns, part])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    local = stage(dealt.mapInArrow(add, schema), name, instead_of=instead_of)
    ends = local.groupBy(part).agg(F.min(group).alias("low"), F.max(group).alias("high"))  # a row for each part
    split = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias(group)).groupBy(group).count().where("count > 1")
    totals = local.join(F.broadcast(split), group).groupBy(F.col(group).alias(group_), part).agg(*(F.max(v).alias(v) for v in values))
    earlier = Window.partitionBy(group_).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group_, F.col(part).alias("_" + part), *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(b) for v, b in zip(values, before, strict=True)))
    joined = local.join(F.broadcast(offsets), (F.col(group) == F.col(group_)) & (F.col(part) == F.col("_" + part)), "left")
    return joined.select(*((F.col(c) + F.coalesce(F.col(before[values.index(c)]), F.lit(0))).alias(c) if c in values else F.col(c) for c in df.columns))
