"""Where results go: tab-separated, JSON and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.plans.lineage import cut, discard


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> bool:
    """write_tsv of a result that has rows; without any nothing is written, and it gives False."""
    made = cut(df, "results")
    there = not made.isEmpty()
    if there:
        write_tsv(made, path)
    discard(made)
    return there


def write_similarities(pairs: DataFrame, path: str) -> None:
    """Scores with six decimals."""
    write_tsv(pairs.select("existing_id", F.format_string("%.6f", "score").alias("score")), path)


def append_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_protein_embeddings(df: DataFrame, path: str, buckets: int = 64) -> None:
    """In folders by a hash of the owner."""
    df.withColumn("owner_bucket", F.pmod(F.xxhash64("owner_id"), F.lit(buckets))).write.partitionBy("owner_bucket").parquet(path)


def write_summary(counts: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON object for each query: its counts, and its similarity edges."""
    listed = edges.groupBy("query_id").agg(F.collect_list(F.struct("src_id", "dst_id", "weight")).alias("similarity_edges"))
    counts.join(listed, "query_id", "left").write.json(path)


def write_sketches(sketches: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """A table bucketed by hash, its files at path: joins on the hash needn't shuffle it."""
    sketches.write.bucketBy(buckets, "hash").sortBy("hash").mode("overwrite").option("path", path).saveAsTable(table)
