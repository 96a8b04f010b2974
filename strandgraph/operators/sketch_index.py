"""A library of reference sketches as an inverted index on disk, probed by batches of queries.

Three tables, bucketed so that a probe shuffles the queries alone: {name}_order (hash, df), how rare each hash is; {name}_postings
(hash, ref_id, n, rank), for each hash the references that have it, their sizes and its place among the reference's hashes by
rarity; {name}_sets (ref_id, hashes). A hash's place in the order never changes: references that are added later take the
order as it is, and their new hashes go to its front. Any order that all sets share finds all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.plans.lineage import cut

#: Buckets of the tables, or the session's partitions where these are more: with fewer, both sides of a join would be shuffled.
BUCKETS = 64


def _buckets(spark: SparkSession, name: str) -> int:
    """Those that the tables have, or that new ones get."""
    if spark.catalog.tableExists(f"{name}_order"):
        rows = spark.sql(f"DESCRIBE FORMATTED {name}_order").filter("col_name = 'Num Buckets'").collect()
        return int(rows[0].data_type)
    return max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _add(df: DataFrame, table: str, key: str, path: str, buckets: int) -> None:
    # One file for each bucket and call.
    df.repartition(buckets, key).write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{table}").saveAsTable(table)


def add_sketches(sketches: DataFrame, name: str, path: str) -> None:
    """Adds sketches (id, hash) to the library of this name, which is made if it isn't there, with its files below path. Ids that the
    library has are an error."""
    spark = sketches.sparkSession
    buckets, there = _buckets(spark, name), spark.catalog.tableExists(f"{name}_order")
    rows = cut(sketches.select("id", "hash").distinct(), "to-index")
    if there and (taken := rows.select(F.col("id").alias("ref_id")).distinct().join(spark.table(f"{name}_sets").select("ref_id"), "ref_id", "left_semi").limit(5).collect()):
        raise ValueError(f"ids are in the library: {[r.ref_id for r in taken]}")
    seen = rows.groupBy("hash").agg(F.count("*").alias("df"))
    old = spark.table(f"{name}_order") if there else None
    fresh = cut(seen if old is None else seen.join(old.select("hash"), "hash", "left_anti").select("hash", F.lit(0).cast("long").alias("df")), "new-hashes")
    order = fresh if old is None else fresh.unionByName(old.join(seen.select("hash"), "hash", "left_semi"))
    ranked = rows.join(order, "hash").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("h"))
    sets = cut(ranked.select(F.col("id").alias("ref_id"), F.col("h.hash").alias("hashes")), "sets")
    postings = sets.select("ref_id", F.size("hashes").alias("n"), F.posexplode("hashes").alias("rank", "hash")).select("hash", "ref_id", "n", "rank")
    _add(sets, f"{name}_sets", "ref_id", path, buckets)
    _add(postings, f"{name}_postings", "hash", path, buckets)
    _add(fresh, f"{name}_order", "hash", path, buckets)


def probe(queries: DataFrame, name: str, threshold: float) -> DataFrame:
    """query_id, ref_id, score of queries (id, hash) and the library's references from a threshold above 0 on: as sketch.jaccard_pairs.

    Queries' hashes get their place in the order, the rarest meet the postings, and the pairs found meet the whole sets. No
    table of the library is shuffled or ranked anew.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0")
    spark = queries.sparkSession
    order, postings, sets = (spark.table(f"{name}_{t}") for t in ("order", "postings", "sets"))
    rows = queries.select(F.col("id").alias("query_id"), "hash").distinct()
    ranked = rows.join(order, "hash", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("h"))
    # Hashes that no reference has come first: they are among the rarest, and meet nothing.
    n = F.size("h")
    first = lambda size: (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int")
    asked = cut(ranked.select("query_id", F.col("h.hash").alias("hashes"), F.transform(F.filter(F.slice("h", F.lit(1), first(n)), lambda x: x["df"].isNotNull()), lambda x: x["hash"]).alias("head")), "asked")
    heads = asked.select("query_id", F.size("hashes").alias("nq"), F.explode("head").alias("hash"))
    close = F.least("nq", "n") >= F.lit(threshold) * F.greatest("nq", "n") - 1e-9
    met = heads.join(postings.filter(F.col("rank") < first(F.col("n"))), "hash").filter(close).select("query_id", "ref_id").distinct()
    whole = met.join(asked.select("query_id", F.col("hashes").alias("x")), "query_id").join(sets.withColumnRenamed("hashes", "y"), "ref_id")
    counted = whole.select("query_id", "ref_id", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sum"))
    return counted.select("query_id", "ref_id", (F.col("common") / (F.col("sum") - F.col("common"))).alias("score")).filter(F.col("score") >= threshold)
