"""Tables in pages: files of consecutive rows, and an index of the rows before each, so that a page opens the files that hold it."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import folder

#: Rows of a file, about.
FILE_ROWS = 1_000_000


@dataclass
class PagedTable:
    """``before``: of each file, in order, the rows before it; the last number is that of all rows."""

    spark: SparkSession
    path: str
    columns: list[str]
    schema: T.StructType
    files: list[int]
    before: list[int]

    @classmethod
    def of(cls, df: DataFrame, order: list[Column] | None = None) -> PagedTable:
        """Written to the shared folder, sorted by ``order`` (ties stay as the deal leaves them), or as the table lies."""
        spark, columns = df.sparkSession, [f"c{i}" for i in range(len(df.columns))]
        rows = df
        if order:
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // FILE_ROWS))
            rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        rows = rows.toDF(*columns)

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, at = TaskContext.get().partitionId(), 0
            for batch in batches:
                if batch.num_rows:
                    place = np.arange(at, at + batch.num_rows)
                    at += batch.num_rows
                    yield batch.append_column("place", pa.array(place)).append_column("file", pa.array(np.full(batch.num_rows, part, np.int32)))

        schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType()), T.StructField("file", T.IntegerType())])
        path = folder(spark, "pages")
        rows.mapInArrow(numbered, schema).write.partitionBy("file").parquet(path)
        stored = spark.read.schema(schema).parquet(path)
        counts = sorted((r["file"], r["n"]) for r in stored.groupBy("file").agg(F.count("*").alias("n")).collect())  # a row for each file
        return cls(spark, path, df.columns, schema, [f for f, _ in counts], [0, *accumulate(n for _, n in counts)])

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit, in order; only the files that hold some are opened, and only their row groups with these places are read."""
        end = min(offset + limit, self.before[-1])
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        if offset >= end:
            return stored.limit(0).drop("place", "file").toDF(*self.columns)
        first, last = bisect_right(self.before, offset) - 1, bisect_right(self.before, end - 1) - 1
        wanted = F.lit(False)
        for i in range(first, last + 1):
            low, high = max(0, offset - self.before[i]), min(end, self.before[i + 1]) - self.before[i]
            wanted = wanted | ((F.col("file") == self.files[i]) & (F.col("place") >= low) & (F.col("place") < high))
        return stored.where(wanted).orderBy("file", "place").drop("place", "file").toDF(*self.columns)
