"""A stage as an incremental job: new files are processed once, results appended.

A stage of the chunk pipeline can be left off and taken up again; what it has done is in
the stream's checkpoint instead of a progress file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_stage(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], target: str, progress: str, files_a_batch: int = 100) -> StreamingQuery:
    """Process the Parquet files in ``source`` that ``progress`` has not seen, append to ``target``, and stop.

    ``stage`` maps a batch to its result rows. A batch is written by overwriting its own
    folder ``batch=<n>``, so one that is repeated after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_a_batch)).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
