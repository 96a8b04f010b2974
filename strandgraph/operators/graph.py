"""A heterogeneous graph as tables: nodes(ntype, idx, id, x), edges(src_type, rel, dst_type, src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.skew import hot_keys, spread_join
from strandgraph.plans.lineage import as_table, cut

RELATION = ("src_type", "rel", "dst_type")


def sizes(nodes: DataFrame) -> DataFrame:
    """ntype, count, width; fails later where width differs from narrow."""
    return nodes.groupBy("ntype").agg(F.count("*").alias("count"), F.max(F.size("x")).alias("width"), F.min(F.size("x")).alias("narrow"))


def checked_sizes(nodes: DataFrame) -> DataFrame:
    """ntype, count, width; a type with features of several widths stops the job."""
    differ = F.concat(F.lit("features of several widths: "), F.col("ntype"))
    return sizes(nodes).select("ntype", "count", F.when(F.col("width") == F.col("narrow"), F.col("width")).otherwise(F.raise_error(differ).cast("int")).alias("width"))


def dense_index(rows: DataFrame, group: str, *order: str | Column, out: str = "idx") -> DataFrame:
    """rows with `out`, 0, 1, 2, ... within each group in order. No group is gathered in one task: rows are sorted within
    slices of the order, and a group begins in a slice where the slices before end. The sorted slices are written once, so
    that ranks and the slices' counts come from the very same slices."""
    order_columns = [F.col(o) if isinstance(o, str) else o for o in order]
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(slices, F.col(group), *order_columns).sortWithinPartitions(F.col(group), *order_columns)
    # Row numbers of a sorted slice: groups are runs of them.
    placed = cut(spread.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "slices")
    # At most one row for each slice and group.
    runs = placed.groupBy(group, "_slice").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col(group).alias("_group"), F.col("_slice").alias("_in"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_in")))
    return joined.withColumn(out, F.col("_at") + F.col("_shift")).drop("_slice", "_at", "_group", "_in", "_shift")


def attach_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and the new ones (ntype, id, x), which get the indices after those that are there, in order of id."""
    base = nodes.groupBy("ntype").agg(F.max("idx").alias("top"))
    placed = dense_index(new, "ntype", "id").join(base, "ntype", "left")
    return nodes.unionByName(placed.select("ntype", (F.coalesce(F.col("top") + 1, F.lit(0)) + F.col("idx")).alias("idx"), "id", "x"))


def conflicts(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes whose id is taken. Neither side is broadcast: both grow with the input."""
    return new.join(nodes.select("ntype", "id").hint("merge"), ["ntype", "id"], "left_semi")


def new_and_reused(nodes: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those whose id is free, and the existing nodes of the others."""
    taken = nodes.select("ntype", "id")
    return proposed.join(taken, ["ntype", "id"], "left_anti"), nodes.join(proposed.select("ntype", "id").distinct(), ["ntype", "id"], "left_semi")


def unique_ids(proposed: DataFrame, existing: DataFrame, order: str = "position") -> DataFrame:
    """proposed(id, position) with assigned_id: the id itself if it is free, else the first free of id_1, id_2, ...

    Taken are existing ids and what rows before (by position) got. Every row first asks for what it would get if other ids'
    rows didn't matter: the n-th row of an id asks for its n-th free name. Of those who ask for one name the first by position
    holds it, perhaps only until an earlier row asks for it; the others ask for their next name in another round. Rounds
    are as many as ids of one kind stand in another's way ("a" and "a_1" as bases), and end, as names only move on.
    """
    name = F.when(F.col("try") == 0, F.col("id")).otherwise(F.concat_ws("_", "id", F.col("try").cast("string")))
    taken = existing.select(F.col("id").alias("assigned_id"), F.lit(True).alias("taken")).distinct()
    first = F.row_number().over(Window.partitionBy("assigned_id").orderBy("position")) == 1
    rows = proposed.select("id", F.col(order).alias("position"))
    state = _first_tries(rows, existing)
    while True:
        asked = state.withColumn("assigned_id", name).join(taken, "assigned_id", "left")
        judged = cut(asked.select("id", "position", "try", "assigned_id", (F.col("taken").isNull() & first).alias("holds")))
        if judged.filter("not holds").isEmpty():
            return judged.select("id", "position", "assigned_id")
        state = judged.select("id", "position", (F.col("try") + F.when(F.col("holds"), 0).otherwise(1)).alias("try"))


def renamed(records: DataFrame, assigned: DataFrame, order: str = "position", out: str = "id") -> DataFrame:
    """records with the ids that unique_ids gave them, the ones they had beside as original_id. Rows are told apart by id and order."""
    names = assigned.select(F.col("id").alias(out), F.col("position").alias(order), "assigned_id")
    return records.join(names, [out, order]).withColumn("original_id", F.col(out)).withColumn(out, F.col("assigned_id")).drop("assigned_id")


def _first_tries(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """rows with try: the number of the n-th free name, for the n-th row of an id."""
    suffix = F.regexp_extract("id", "_([1-9][0-9]{0,17})$", 1)
    own = existing.select("id", F.lit(0).cast("long").alias("number"))
    numbered = existing.filter(suffix != "").select(F.regexp_replace("id", "_[1-9][0-9]*$", "").alias("id"), suffix.cast("long").alias("number"))
    used = own.unionByName(numbered).distinct().join(rows.select("id").distinct(), "id", "left_semi")
    # A used number has as many free ones before it as it is larger than its rank among the used ones. Rows rank among
    # them: a row's rank in both is its number of rows before plus the used numbers that its own passes.
    gaps = dense_index(used, "id", "number").select("id", (F.col("number") - F.col("idx")).alias("free"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["position"].dataType).alias("position"))
    nth = dense_index(rows, "id", "position").select("id", F.col("idx").alias("free"), F.lit(1).alias("kind"), "position")
    both = dense_index(gaps.unionByName(nth), "id", "free", "kind")
    return both.filter("kind = 1").select("id", "position", F.col("idx").alias("try"))


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by id (src_type, rel, dst_type, src_id, dst_id, ...) with indices; those with an unknown end go. Ends that very many
    edges share are met in several tasks."""
    at = nodes.select("ntype", "id", "idx")
    src = at.toDF("src_type", "src_id", "src")
    dst = at.toDF("dst_type", "dst_id", "dst")
    edges = as_table(edges, "id-edges")
    # Ids come before types: rows that are sorted by a key are told apart by its beginning.
    hot_src, hot_dst = hot_keys(edges, ["src_id", "src_type"], ["dst_id", "dst_type"])
    return spread_join(spread_join(edges, src, ["src_id", "src_type"], hot_src), dst, ["dst_id", "dst_type"], hot_dst)


def both_directions(edges: DataFrame, back: str) -> DataFrame:
    """edges and their reverse under the relation `back`."""
    one = F.struct(*RELATION, "src", "dst")
    other = F.struct(F.col("dst_type").alias("src_type"), F.lit(back).alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    # Both come from one row, so that what edges are made from runs once.
    return edges.select(F.inline(F.array(one, other)))


def attach_edges(edges: DataFrame, *more: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (m.select(*RELATION, "src", "dst") for m in more), edges.select(*RELATION, "src", "dst"))


def attach_counts(queries: DataFrame, proteins: DataFrame, proposed: DataFrame, attached: DataFrame) -> DataFrame:
    """For each query: nodes, proteins, edges in both directions, similarity edges proposed and attached."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    out = queries.select("query_id").distinct().withColumn("query_nodes", F.lit(1))
    for df, name in ((proteins, "protein_nodes"), (proposed, "similarity_proposed"), (attached, "similarity_attached")):
        out = out.join(n(df, name), "query_id", "left")
    filled = out.fillna(0)
    return filled.withColumn("encodes_edges", F.col("protein_nodes")).withColumn("encoded_by_edges", F.col("protein_nodes"))


def attach_queries(nodes: DataFrame, edges: DataFrame, queries: DataFrame, proteins: DataFrame, similarities: DataFrame, kinds: tuple[str, str] = ("phage", "protein"), rels: tuple[str, str, str] = ("interacts", "encodes", "encoded_by")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with all queries attached at once, and the counts of each query.

    queries: query_id, x; proteins: query_id, protein_id, x; similarities: query_id, src_id, dst_id (ids of the first kind).
    A query or protein whose id is taken is an error. Similarity edges with an unknown end are proposed, not attached.
    """
    kind, part = kinds
    new = queries.select(F.lit(kind).alias("ntype"), F.col("query_id").alias("id"), "x").unionByName(proteins.select(F.lit(part).alias("ntype"), F.col("protein_id").alias("id"), "x"))
    taken = conflicts(nodes, new).select("id").limit(5).collect()
    if taken:
        raise ValueError(f"ids are taken: {[r.id for r in taken]}")
    grown = cut(attach_nodes(nodes, new), "nodes")
    label = lambda df, r, a, b: df.withColumns({"src_type": F.lit(a), "rel": F.lit(r), "dst_type": F.lit(b)})
    encodes = resolved(label(proteins.select(F.col("query_id").alias("src_id"), F.col("protein_id").alias("dst_id")), rels[1], kind, part), grown)
    near = resolved(label(similarities.select("query_id", "src_id", "dst_id"), rels[0], kind, kind), grown)
    return grown, attach_edges(edges, both_directions(encodes, rels[2]), near), attach_counts(queries, proteins, similarities, near)
