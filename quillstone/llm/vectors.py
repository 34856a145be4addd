"""Parts that the vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of one dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def most_common_dimension(rows: DataFrame) -> DataFrame:
    """Rows whose vector ``v`` has the dimension that most have, of equals the largest."""
    sizes = rows.select(F.size("v").alias("d")).filter("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (most[0].d if most else 0)) if most else rows.filter("false")


def first_of_alike(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors, those that can be among the k best of any query: k rows
    of each of the k + 1 smallest ids, as a query leaves out the rows of its own id.

    The rank limits also run below the exchange, so that each map task passes on few rows
    of a vector that a third of the table may share.
    """
    same = F.md5(F.concat_ws(",", F.col("v").cast("array<string>")).cast("binary"))
    each = F.row_number().over(Window.partitionBy("same", "id").orderBy("id"))
    ids = F.dense_rank().over(Window.partitionBy("same").orderBy("id"))
    found = rows.withColumn("same", same).withColumn("nth", each).filter(F.col("nth") <= k).drop("nth")
    return found.withColumn("nth", ids).filter(F.col("nth") <= k + 1).drop("same", "nth")


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]
