"""Cells that arrive over time are compared with those that are there, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairs import gw_pairwise, gw_query_target


def compare_arrivals(arriving: DataFrame, known: str, out: str, checkpoint: str) -> StreamingQuery:
    """For each batch of spaces (id, n, d, mass): distances among them and to all spaces in the table `known`, appended to the table `out`; then
    the batch joins `known`. A batch that is tried again overwrites its own part of both tables."""

    def each(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        part = f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{known}/{part}")
        new = spark.read.schema(batch.schema).parquet(f"{known}/{part}")
        found = gw_pairwise(new)
        try:
            before = spark.read.parquet(known).filter(f"batch < {number}").drop("batch")
            found = found.unionByName(gw_query_target(new, before))
        except AnalysisException:
            pass  # nothing is known yet
        found.write.mode("overwrite").parquet(f"{out}/{part}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
