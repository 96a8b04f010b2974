"""Graphs, model parameters, sketches and file listings as tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "ntype string, idx long, id string, x array<float>"
EDGES = "src_type string, rel string, dst_type string, src long, dst long"
PARAMS = "name string, shape array<int>, data array<double>"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes in folders by type, edges by relation: readers of one type or relation open its folder only."""
    nodes.write.partitionBy("ntype").parquet(f"{path}/nodes")
    edges.write.partitionBy("src_type", "rel", "dst_type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges")


def write_params(spark: SparkSession, params: dict[str, np.ndarray], path: str) -> None:
    rows = [(k, list(v.shape), np.asarray(v, dtype=float).ravel().tolist()) for k, v in params.items()]
    spark.createDataFrame(rows, PARAMS).coalesce(1).write.parquet(path)


def read_params(spark: SparkSession, path: str, wanted: Iterable[str] | None = None) -> dict[str, np.ndarray]:
    """Name -> array; names may stand under model_state. wanted: exactly these names must be there.

    Parameters are of the model's size, whatever the data's, and so may be collected.
    """
    rows = spark.read.schema(PARAMS).parquet(path).select(F.regexp_replace("name", r"^model_state\.", "").alias("name"), "shape", "data").collect()
    out = {r.name: np.array(r.data, dtype=float).reshape(r.shape) for r in rows}
    if wanted is not None and set(wanted) != set(out):
        raise ValueError(f"missing: {sorted(set(wanted) - set(out))}; unexpected: {sorted(set(out) - set(wanted))}")
    return out


def params_table(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """name, shape, data of parameters as a table, names without model_state. wanted(name): exactly these must be there."""
    rows = spark.read.schema(PARAMS).parquet(path).withColumn("name", F.regexp_replace("name", r"^model_state\.", ""))
    if wanted is not None:
        missing, unexpected = missing_names(wanted, rows), missing_names(rows, wanted)
        if odd := missing.limit(5).collect() + unexpected.limit(5).collect():
            raise ValueError(f"missing or unexpected: {sorted(r.name for r in odd)}")
    return rows


def missing_names(required: DataFrame, present: DataFrame) -> DataFrame:
    """Names that are required and not there."""
    return required.select("name").exceptAll(present.select("name").distinct())


def checked_width(embeddings: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """embeddings; a row of another width stops the job."""
    ok = F.size(column) == width
    return embeddings.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} should have {width} numbers, not "), F.size(column).cast("string"))).cast(embeddings.schema[column].dataType)))


def read_sketches(spark: SparkSession, table: str) -> DataFrame:
    """id, hash, abund of a table from sinks.write_sketches."""
    return spark.table(table).select("id", "hash", "abund")


def files(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """path, name, length of the files below folder with one of the suffixes, in any case; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.substring_index("path", "/", -1).alias("name"), "length")
    return listed.filter(F.lower("name").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
