"""Running totals over a whole table in a total order, without a window over one partition."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundix.session import cut_lineage

_PART = "__part"


def running_totals(df: DataFrame, order: Sequence[Column], totals: Mapping[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """For each (new name, long column): the sum over all earlier rows; and the sums over all rows.

    Rows are dealt to ranges of ``order`` (which should have no ties), sorted, and checkpointed. Each range is
    summed, the sums of the ranges (one row per partition) go to the driver, and each range adds its own
    running sum to its offset. NULL counts as 0.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut_lineage(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(_PART, F.spark_partition_id())
    )
    sums = held.groupBy(_PART).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in dict.fromkeys(totals.values())]).collect()
    offsets: dict[int, dict[str, int]] = {}
    reached = dict.fromkeys(totals.values(), 0)
    for row in sorted(sums, key=lambda r: r[_PART]):
        offsets[row[_PART]] = dict(reached)
        for column in reached:
            reached[column] += row[column]
    names = dict(totals)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(_PART).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            arrays = {column: np.zeros(len(ids), dtype=np.int64) for column in set(names.values())}
            for first, last in zip(cuts, cuts[1:]):
                if ids[first] != part:
                    part = ids[first]
                    at = dict(offsets[int(part)])
                for column, out in arrays.items():
                    here = batch.column(column).fill_null(0).to_numpy()[first:last]
                    steps = np.cumsum(here)
                    out[first:last] = at[column] + steps - here
                    at[column] += int(steps[-1])
            kept = [n for n in batch.schema.names if n != _PART]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(arrays[c]) for c in names.values()], names=kept + list(names)
            )

    schema = held.drop(_PART).schema
    for name in names:
        schema = schema.add(name, "long")
    return held.mapInArrow(scan, schema), {name: reached[column] for name, column in names.items()}
