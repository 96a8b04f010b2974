"""Labels by lookup and by walks up a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.plans.lineage import cut, discard


def first_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key, with all columns. Partial aggregates go ahead of the shuffle."""
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*other), order).alias("x")).select(key, "x.*")


def last_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*other), order).alias("x")).select(key, "x.*")


def ancestors(nodes: DataFrame, starts: DataFrame, rank: str, unknown: str = "NA") -> DataFrame:
    """taxid, name: for each different start the first node of the rank on the way up, itself included.

    nodes: taxid, parent, name, rank. The way ends at a root, at a node that is missing, or on a cycle; then, and for
    negative or null starts, the name is `unknown`. Ways are doubled in length in each round: every node learns what the
    node at its way's end has found and where that one's way leads, so rounds grow with the logarithm of the depth.
    """
    there = F.col("rank").eqNullSafe(rank)
    up = F.when(~there & (F.col("parent") != F.col("taxid")), F.col("parent"))
    ways = cut(nodes.select("taxid", F.when(there, F.col("name")).alias("name"), up.alias("next")), "ways")
    left = ways.filter("next is not null").count()
    while left:
        ahead = ways.select(F.col("taxid").alias("next"), F.col("name").alias("found"), F.col("next").alias("further"))
        open_ways = ways.filter("next is not null").join(ahead, "next", "left").select("taxid", F.col("found").alias("name"), F.col("further").alias("next"))
        longer = cut(ways.filter("next is null").unionByName(open_ways), "ways")
        discard(ways)
        ways, before, left = longer, left, longer.filter("next is not null").count()
        # The nodes of a longer way include one that ends in this round; where none ended, the others are on cycles.
        if left == before:
            break
    return starts.select("taxid").distinct().join(ways.select("taxid", "name"), "taxid", "left").select("taxid", F.coalesce("name", F.lit(unknown)).alias("name"))


#: Letters of a node in a path.
STEP = 16


def _step(taxid: Column) -> Column:
    """A node as text of one width, in the order of its number."""
    return F.lpad(F.hex(taxid.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), STEP, "0")


def paths(nodes: DataFrame) -> DataFrame:
    """taxid, path: each node's way from its root, STEP letters a node; null where the way up runs into a cycle.

    A subtree is a range of paths (see subtree), and a path's beginnings are a node's ancestors. Ways double in length in each
    round. A new leaf's path is its parent's and its own step, so appending one changes no other path (see with_leaves).
    """
    there = nodes.select(F.col("taxid").alias("parent")).distinct()
    up = nodes.filter("parent <> taxid").select("taxid", "parent").join(there, "parent", "left_semi")
    ways = cut(nodes.select("taxid").join(up, "taxid", "left").select("taxid", _step(F.col("taxid")).alias("path"), F.col("parent").alias("next")), "ways")
    left = ways.filter("next is not null").count()
    while left:
        ahead = ways.select(F.col("taxid").alias("next"), F.col("path").alias("front"), F.col("next").alias("further"))
        longer = ways.filter("next is not null").join(ahead, "next").select("taxid", F.concat("front", "path").alias("path"), F.col("further").alias("next"))
        again = cut(ways.filter("next is null").unionByName(longer), "ways")
        discard(ways)
        ways, before, left = again, left, again.filter("next is not null").count()
        if left == before:
            break
    return ways.select("taxid", F.when(F.col("next").isNull(), F.col("path")).alias("path"))


def with_leaves(labels: DataFrame, leaves: DataFrame) -> DataFrame:
    """labels (see paths) and those of leaves(taxid, parent) below them; a leaf without a known parent is a root."""
    above = labels.select(F.col("taxid").alias("parent"), F.col("path").alias("front"), F.lit(True).alias("known"))
    new = leaves.select("taxid", "parent").join(above, "parent", "left")
    path = F.when(F.col("known").isNull(), _step(F.col("taxid"))).otherwise(F.concat("front", _step(F.col("taxid"))))
    return labels.unionByName(new.select("taxid", path.alias("path")))


def subtree(labels: DataFrame, path: str) -> DataFrame:
    """labels of a node and all below it: one range of paths."""
    return labels.filter((F.col("path") >= path) & (F.col("path") < path + "G"))


def ancestors_by_path(labels: DataFrame, nodes: DataFrame, starts: DataFrame, rank: str, unknown: str = "NA") -> DataFrame:
    """As ancestors, by lookups: the nodes of a start's path meet the nodes of the rank, and the nearest counts. Starts whose way
    runs into a cycle are walked."""
    asked = starts.select("taxid").distinct().join(labels.withColumn("labelled", F.lit(True)), "taxid", "left")
    places = F.sequence(F.lit(1), F.length("path") - STEP + 1, F.lit(STEP))
    each = asked.filter("path is not null").select("taxid", "path", F.explode(places).alias("at")).select("taxid", "at", F.substr("path", F.col("at"), F.lit(STEP)).alias("step"))
    wanted = nodes.filter(F.col("rank") == rank).select(_step(F.col("taxid")).alias("step"), "name")
    found = each.join(wanted, "step").groupBy("taxid").agg(F.max_by("name", "at").alias("name"))
    lost = asked.filter("path is null and labelled").select("taxid")
    odd = labels.filter("path is null").select("taxid")
    walked = ancestors(nodes.join(odd, "taxid", "left_semi"), lost, rank, unknown)
    straight = asked.filter("path is not null or labelled is null").select("taxid").join(found, "taxid", "left").select("taxid", F.coalesce("name", F.lit(unknown)).alias("name"))
    return straight.unionByName(walked)


def host_taxids(hosts: DataFrame, catalog: DataFrame, order: Column) -> DataFrame:
    """idx, host, taxid: the first catalog row of each host counts, even if its taxid is null; -1 where none is known."""
    first = first_by(catalog, "host", order).select("host", "taxid")
    return hosts.join(first, "host", "left").select("idx", "host", F.coalesce("taxid", F.lit(-1)).alias("taxid"))


def with_species(rows: DataFrame, species: DataFrame) -> DataFrame:
    """rows with species by taxid, or unknown_<taxid>."""
    return rows.join(species.select("taxid", "species"), "taxid", "left").withColumn("species", F.coalesce("species", F.concat(F.lit("unknown_"), F.col("taxid").cast("string"))))


def labelled(best: DataFrame, hosts: DataFrame, species: DataFrame, genera: DataFrame, mode: str | None = None) -> DataFrame:
    """query_id, top_species and/or top_genus, and the score with six decimals. best: query_id, idx, score; hosts: idx, taxid;
    genera: taxid, name. mode: None, "species" or "genus"."""
    rows = best.join(hosts.select("idx", "taxid"), "idx", "left").withColumn("taxid", F.coalesce("taxid", F.lit(-1)))
    rows = with_species(rows, species).join(genera.select("taxid", F.col("name").alias("top_genus")), "taxid", "left")
    rows = rows.withColumn("top_genus", F.coalesce("top_genus", F.lit("NA"))).withColumnRenamed("species", "top_species").withColumn("score", F.round("score", 6))
    return rows.select("query_id", *{None: ("top_species", "top_genus"), "species": ("top_species",), "genus": ("top_genus",)}[mode], "score")
