"""Files that arrive: each record is handled once, however often the job runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.sequence import header_token


def new_records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of FASTA records seq_id, seq of files that appear below folder. Text before a file's first header isn't told
    from a record here: files begin with '>'."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    return raw.select(text.alias("text"), F.col("_metadata.file_name").alias("source_file")).select(
        header_token(F.substring_index("text", "\n", 1)).alias("seq_id"), F.regexp_replace(F.expr("substr(text, length(substring_index(text, '\n', 1)) + 1)"), r"\s", "").alias("seq"), "source_file"
    )


def ingest(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> int:
    """Handles what has arrived since the last run, adds the result to the table at path, and gives its number of rows in.

    A batch that is run again after a failure overwrites its own folder, so its rows count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).withColumn("ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.get("numInputRows", 0) for p in query.recentProgress)
