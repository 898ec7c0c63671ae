"""Templates of a growing log: lines are mined batch by batch with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.lines import with_shape
from tessera.operators.templates import STANDARD, MiningOptions, mine_templates


def shape_counts(lines: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Running hits of each shape in windows of event time; lines that come after the watermark are left out.

    ``lines(ts, line)`` may be a stream; the state is one row for each open window and shape.
    """
    shaped = with_shape(lines).where(F.size("vars") >= 1).withWatermark("ts", watermark)
    return shaped.groupBy(F.window("ts", window), F.array_join("parts", "\x00").alias("shape")).agg(F.count("*").alias("hits"))


def mine_batches(lines: DataFrame, path: str, checkpoint: str, options: MiningOptions = STANDARD) -> StreamingQuery:
    """Mines every micro-batch of ``lines(file, line_no, line)`` and appends its templates, with ``batch_id``, to ``path``.

    The batch's part of the path is replaced if the batch runs again after a failure.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        mine_templates(batch, ["file"], options).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
