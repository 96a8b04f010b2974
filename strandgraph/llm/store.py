"""Tables in the shared folder, and the identity of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.text import NULL_KEY
from strandgraph.plans.lineage import cut as written
from strandgraph.plans.lineage import discard, shared_folder

__all__ = ["discard", "shared_folder", "written"]

#: Text bytes for a task that holds a bucket of them after a shuffle, so that tasks stay small however large the input is.
TASK_BYTES = 64 << 20


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def task_count(spark, n_bytes: int) -> int:
    """Tasks for so many bytes: those that the session sets, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))


def key_of(name: str) -> Column:
    """An id as a non-null key; a null id counts as the smallest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))


def id_of(key: str = "k") -> Column:
    """The id again from key_of."""
    return F.when(F.col(key) != NULL_KEY, F.col(key))


def keyed_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The key k and the text alone, whatever other columns there are."""
    return docs.select(key_of(id_column).alias("k"), F.col(text_column).cast("string").alias("text"))


#: Ids that more than one row has are broadcast up to so many of them and shuffled beyond.
BROADCAST_IDS = 500_000
IDENTITY = ("k", "v1", "v2")


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", names: tuple[str, str, str] = IDENTITY) -> tuple[DataFrame, bool]:
    """docs with a row identity in three columns more: the key, and the MD5 of the text in two halves where several rows
    have the key, else zeros; and whether there are such keys. Rows of one identity have one id and one text. Rows of one
    id are in the order of the identity."""
    k, v1, v2 = names
    keyed = docs.withColumn(k, key_of(id_column))
    several = written(keyed.groupBy(k).agg(F.count("*").alias("n")).filter("n > 1").select(k, F.lit(True).alias("several_of_row")), "several-ids")
    n = several.limit(BROADCAST_IDS + 1).count()
    if not n:
        discard(several)
        return keyed.withColumn(v1, F.lit(0).cast("long")).withColumn(v2, F.lit(0).cast("long")), False
    joined = keyed.join(F.broadcast(several) if n <= BROADCAST_IDS else several, k, "left")
    md5 = F.md5(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    half = lambda at: F.when(F.col("several_of_row"), F.conv(F.substring(md5, at, 16), 16, -10).cast("long")).otherwise(F.lit(0).cast("long"))
    return joined.withColumn(v1, half(1)).withColumn(v2, half(17)).drop("several_of_row"), True


def identified_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, bool]:
    """IDENTITY and the text alone, and whether several rows have one id."""
    rows, several = identified(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), "id", "text")
    return rows.select(*IDENTITY, "text"), several
