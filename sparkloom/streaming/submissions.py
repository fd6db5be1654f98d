"""Submissions that arrive as a stream, registered in a ledger as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger_tables import Ledger


def registering(stream: DataFrame, book: Ledger, order: str, results: str, checkpoint: str, threshold: float = 0.5, allow_near: bool = False, once: bool = False) -> StreamingQuery:
    """Start to register stream(SUBMISSION, order) in the ledger, a micro-batch as one write; (slug, status, batch) of each is added to
    Parquet in `results`. once: stop when all that is there now is done.

    Within a micro-batch rows count in their order, and of those that repeat a slug the first. A micro-batch that is run again after a
    failure finds its own rows in the ledger: they are told as exact collisions then, and nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("slug").agg(F.min_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        done = book.register(first, order, threshold, allow_near)
        done.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(results)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
