"""Sketches of sequences, and similarity of sketches as a join on hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.sequence import kept_hashes, kept_sets
from strandgraph.operators.skew import hot_keys, spread_join
from strandgraph.plans.lineage import cut


#: Hashes are below this.
TOP = 1 << 60


def sketch(sequences: DataFrame, k: int, scaled: int, id_column: str = "id", seq: str = "seq") -> DataFrame:
    """id, hash, abund: the hashes of canonical k-mers below TOP / scaled, with their number of occurrences.

    Sketches are made where the sequences are, and only they are shuffled, since an id may have several rows. Sequences shorter
    than k have none; k-mers with other letters than A, C, G and T don't count.
    """
    return kept_hashes(sequences, k, TOP // scaled, id_column, seq).groupBy("id", "hash").agg(F.sum("abund").alias("abund"))


def sketch_sets(sequences: DataFrame, k: int, scaled: int, id_column: str = "id", seq: str = "seq") -> DataFrame:
    """id, hashes: the sketches as sorted arrays, without numbers of occurrences. A sketch travels as one row, not as a row a hash."""
    parts = kept_sets(sequences, k, TOP // scaled, id_column, seq).groupBy("id").agg(F.collect_list("hashes").alias("p"))
    return parts.select("id", F.when(F.size("p") == 1, F.col("p")[0]).otherwise(F.sort_array(F.array_distinct(F.flatten("p")))).alias("hashes"))


def jaccard_pairs(queries: DataFrame, references: DataFrame, threshold: float = 0.0) -> DataFrame:
    """query_id, ref_id, score of sketches that share a hash, from a threshold on.

    With a threshold t, two sets that reach it share ceil(t n) hashes or more, so they share one of each one's
    n - ceil(t n) + 1 rarest: pairs are made from these alone, without those whose sizes rule the threshold out, and then
    the whole sets are compared.
    """
    q = queries.select(F.col("id").alias("query_id"), "hash").distinct()
    r = references.select(F.col("id").alias("ref_id"), "hash").distinct()
    if threshold <= 0:
        q = q.join(q.groupBy("query_id").agg(F.count("*").alias("nq")), "query_id")
        r = r.join(r.groupBy("ref_id").agg(F.count("*").alias("nr")), "ref_id")
        both = q.join(r, "hash").groupBy("query_id", "ref_id", "nq", "nr").agg(F.count("*").alias("common"))
        return both.select("query_id", "ref_id", (F.col("common") / (F.col("nq") + F.col("nr") - F.col("common"))).alias("score"))
    seen = r.groupBy("hash").agg(F.count("*").alias("df"))
    sets = lambda rows, key: cut(rows.groupBy(key).agg(F.collect_list("hash").alias("hashes")), "sets")
    a, b = _ranked(sets(q, "query_id"), seen, "query_id", threshold), _ranked(sets(r, "ref_id"), seen, "ref_id", threshold)
    return _verified(_met(a, b, threshold), a, b, threshold)


@dataclass
class Classes:
    """Equal sketches as one class. sets: class_id (its smallest id), hashes; members: id, class_id."""

    sets: DataFrame
    members: DataFrame


def classes(sketches: DataFrame) -> Classes:
    """The classes of equal sketches (id, hash); see classes_of_sets."""
    return classes_of_sets(sketches.groupBy("id").agg(F.sort_array(F.collect_set("hash")).alias("hashes")))


def classes_of_sets(sets: DataFrame) -> Classes:
    """The classes of equal sketches (id, hashes: sorted); a copy costs a row of members. Sets are told apart by MD5. A class with very many
    members isn't gathered: its smallest id is an aggregate that tasks make in part, and reaches the members in several tasks."""
    keyed = cut(sets.withColumn("digest", F.md5(F.array_join("hashes", ",").cast("binary"))), "sets")
    first = keyed.groupBy("digest").agg(F.min("id").alias("class_id"))
    (hot,) = hot_keys(keyed, ["digest"])
    members = cut(spread_join(keyed.select("id", "digest"), first, ["digest"], hot).select("id", "class_id"), "members")
    # Read several times, so written once.
    own = cut(keyed.join(first.select(F.col("class_id").alias("id")), "id", "left_semi").select(F.col("id").alias("class_id"), "hashes"), "class-sets")
    return Classes(own, members)


def similar_classes(found: Classes, threshold: float) -> DataFrame:
    """class_a < class_b, score: the pairs of classes from a threshold above 0 on, each once. Members of one class are alike
    (score 1) and make no pair, so S equal sketches give S rows of members and not S * S pairs."""
    pairs = _pairs_of(found.sets.withColumnRenamed("class_id", "query_id"), threshold)
    return pairs.select(F.col("query_id").alias("class_a"), F.col("ref_id").alias("class_b"), "score")


def lsh_classes(found: Classes, threshold: float, bands: int = 16, rows: int = 4) -> DataFrame:
    """class_a < class_b, score: similar_classes by minima of hashes, `rows` of them a band. Two sets that are s alike share all
    minima of a band with a chance of s ** rows, so a pair is found with one of 1 - (1 - s ** rows) ** bands (0.9998 at 0.8); what is
    found is then compared whole. Work goes with the buckets' pairs, not with how common hashes are."""
    each = found.sets.select(F.col("class_id").alias("id"), F.explode("hashes").alias("hash"))
    minima = each.groupBy("id").agg(*(F.min(F.xxhash64("hash", F.lit(j))).alias(f"m{j}") for j in range(bands * rows)))
    keys = F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(*(f"m{b * rows + j}" for j in range(rows))).alias("key")) for b in range(bands)))
    placed = minima.select("id", F.inline(keys))
    met = placed.withColumnRenamed("id", "query_id").join(placed.withColumnRenamed("id", "ref_id"), ["band", "key"]).filter("query_id < ref_id").select("query_id", "ref_id").distinct()
    of = lambda name: found.sets.select(F.col("class_id").alias(name), "hashes")
    return _verified(met, of("query_id"), of("ref_id"), threshold).select(F.col("query_id").alias("class_a"), F.col("ref_id").alias("class_b"), "score")


def expanded(found: Classes, pairs: DataFrame) -> DataFrame:
    """query_id, ref_id, score of all pairs of different members, both ways: as many rows as there are such pairs."""
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "score"))
    query, ref = (found.members.select(F.col("id").alias(name), F.col("class_id").alias(c)) for name, c in (("query_id", "class_a"), ("ref_id", "class_b")))
    several = found.members.groupBy(F.col("class_id").alias("class_a")).agg(F.count("*").alias("n")).filter("n > 1")
    own = several.select("class_a", F.col("class_a").alias("class_b"), F.lit(1.0).alias("score"))
    return both.unionByName(own).join(query, "class_a").join(ref, "class_b").filter("query_id <> ref_id").select("query_id", "ref_id", "score")


def best_of_classes(found: Classes, pairs: DataFrame) -> DataFrame:
    """query_id, ref_id, score: each member's best other one, of equally good ones that of the smallest id. No pair of members is
    made: the best is the smallest other member of its own class, else the best class's smallest."""
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "score"))
    other = best_match(both.select(F.col("class_a").alias("query_id"), F.col("class_b").alias("ref_id"), "score")).select(F.col("query_id").alias("class_id"), "ref_id", "score")
    second = found.members.filter("id <> class_id").groupBy("class_id").agg(F.min("id").alias("second"))
    of_class = found.sets.select("class_id").join(second, "class_id", "left").join(other, "class_id", "left")
    (hot,) = hot_keys(found.members, ["class_id"])
    rows = spread_join(found.members, of_class, ["class_id"], hot)
    own = F.when(F.col("second").isNotNull(), F.when(F.col("id") == F.col("class_id"), F.col("second")).otherwise(F.col("class_id")))
    return rows.select(F.col("id").alias("query_id"), F.coalesce(own, "ref_id").alias("ref_id"), F.when(own.isNotNull(), 1.0).otherwise(F.col("score")).alias("score")).filter("ref_id is not null")


def similar_pairs(sketches: DataFrame, threshold: float) -> DataFrame:
    """query_id < ref_id, score: the pairs of one table's sketches from a threshold above 0 on, each once. See jaccard_pairs;
    where many sketches are equal, similar_classes."""
    return _pairs_of(cut(sketches.groupBy(F.col("id").alias("query_id")).agg(F.collect_set("hash").alias("hashes")), "sets"), threshold)


def _pairs_of(sets: DataFrame, threshold: float) -> DataFrame:
    """similar_pairs of a table query_id, hashes: different ones."""
    # A hash that one set alone has makes no pair.
    seen = sets.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    a = _ranked(sets, seen, "query_id", threshold)
    b = a.withColumnsRenamed({"query_id": "ref_id"})
    return _verified(_met(a, b, threshold).filter("query_id < ref_id"), a, b, threshold)


def _ranked(sets: DataFrame, seen: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, hashes, n, head of sets (key, hashes: different ones) that can be in a pair: each as an array, its size, and its hashes that pairs
    are made from. seen: hash, df of those that may have a partner; the others are the rarest, and count as a set's, but only these
    travel. Pairs are made from the ranks and verified by them, so they are written once."""
    rows = sets.select(key, F.explode("hashes").alias("hash")).join(seen, "hash")
    ranks = sets.join(rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("h")), key)
    n = F.size("hashes")
    # A trifle less than the product, so that rounding makes a head longer, never shorter.
    head = F.slice("h.hash", F.lit(1), F.greatest(F.size("h") - F.ceil(n * F.lit(threshold) - 1e-9) + 1, F.lit(0)).cast("int"))
    return cut(ranks.select(key, "hashes", n.alias("n"), head.alias("head")).filter(F.size("head") > 0), "ranks")


def _met(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    q = a.select("query_id", F.col("n").alias("nq"), F.explode("head").alias("hash"))
    r = b.select("ref_id", F.col("n").alias("nr"), F.explode("head").alias("hash"))
    close = F.least("nq", "nr") >= F.lit(threshold) * F.greatest("nq", "nr") - 1e-9
    return q.join(r, "hash").filter(close).select("query_id", "ref_id").distinct()


def _verified(pairs: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    full = pairs.join(a.select("query_id", F.col("hashes").alias("x")), "query_id").join(b.select("ref_id", F.col("hashes").alias("y")), "ref_id")
    common = F.size(F.array_intersect("x", "y"))
    counted = full.select("query_id", "ref_id", common.alias("common"), (F.size("x") + F.size("y")).alias("sum"))
    return counted.select("query_id", "ref_id", (F.col("common") / (F.col("sum") - F.col("common"))).alias("score")).filter(F.col("score") >= threshold)


def similarity_edges(pairs: DataFrame, threshold: float, edge_type: str, both_ways: bool = False) -> DataFrame:
    """src_id, dst_id, edge_type, weight from query_id, ref_id, score: positive scores from the threshold on, the smaller
    id as source, or both directions."""
    kept = pairs.filter((F.col("score") >= threshold) & (F.col("score") > 0))
    low, high = F.least("ref_id", "query_id"), F.greatest("ref_id", "query_id")
    one = kept.select(low.alias("src_id"), high.alias("dst_id"), F.lit(edge_type).alias("edge_type"), F.col("score").alias("weight"))
    return one.unionByName(one.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "edge_type", "weight")) if both_ways else one


def best_match(pairs: DataFrame) -> DataFrame:
    """The best reference of each query; of equally good ones that of the smallest id."""
    best = pairs.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ref_id")).alias("m"))
    return best.select("query_id", F.col("m.ref_id").alias("ref_id"), (-F.col("m.s")).alias("score"))
