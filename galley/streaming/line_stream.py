"""Line checks over a stream of documents.

They need one document at a time and keep no state, so a streaming ``books``
goes through the same plan as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from galley.operators.line_checks import line_findings
from galley.sources.books import from_table


def stream_books(
    spark: SparkSession, folder: str, schema: str = "doc_id long, text string"
) -> DataFrame:
    """Documents arriving as Parquet files in a folder."""
    return from_table(spark.readStream.schema(schema).parquet(folder))


def stream_line_findings(
    books: DataFrame, target: str, checkpoint: str, checks: list[str] | None = None
) -> StreamingQuery:
    """Write findings by check as documents arrive, then stop when caught up.

    ``checkpoint`` is a lasting folder of this stream alone: a later session
    that names it again goes on where this one stopped.
    """
    return (
        line_findings(books, checks)
        .writeStream.format("parquet")
        .partitionBy("check")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
