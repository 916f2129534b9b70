"""The metrics over a stream of scores: counts by score accumulate, and curves come from the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def accumulate(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's counts by score (score, t, f, batch) to a table. A batch that is written
    again after a failure replaces itself, as its folder is named by its number."""

    def write(batch: DataFrame, number: int) -> None:
        by = batch.groupBy("score").agg(F.sum("y").cast("long").alias("t"), F.sum(1 - F.col("y")).cast("long").alias("f"))
        by.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_scores(counts: DataFrame) -> DataFrame:
    """Counts as rows (score, y, weight), summed over batches."""
    c = counts.groupBy("score").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    return c.select("score", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("t").alias("weight")), F.struct(F.lit(0).alias("y"), F.col("f").alias("weight")))).alias("v")).select("score", "v.*").where("weight > 0")
