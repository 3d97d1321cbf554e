"""Where rows are worked on."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input that keep one task busy; tables of fewer for each core are dealt out.
TASK_BYTES = 32 << 20


def spread(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """df, its rows dealt out over the cores if the whole table is so small that it would be read by a few tasks.

    A Parquet row group is read by one task, and row-wise operators keep its
    rows there; large tables have row groups enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df
