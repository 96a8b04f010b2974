"""Sharding by vector bin packing.

Bytes, tokens and rows are balanced jointly: largest first, each group goes to the shard where the dot product
of its size with the shard's residual capacity is highest. Groups are documents of equal text. What is packed
one by one is of bounded number whatever the input: groups above 1 / HEAVY of a shard stand alone, in parts if
they exceed half a shard; all others are dealt by hash into BUNDLES bundles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.store import discard, id_of, key_of, written
from strandgraph.operators.graph import dense_index

#: Bundles of light groups for each shard.
BUNDLES = 256
#: A group with more than 1 / HEAVY of a shard's capacity in some dimension is packed by itself.
HEAVY = 64
#: Parts of a group of half a shard; a part is as large as a bundle or so, so that the rest fits around it.
PARTS = 8
DIMENSIONS = ("size", "tokens", "rows")
#: What a dimension counts in the dot product: the law is `bytes`, so near-equal bytes come first.
WEIGHTS = (1.0, 0.05, 0.05)


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. items: their sizes in all dimensions, one row each.

    Sizes and capacities are shares of a shard, weighted by WEIGHTS; what has overflowed counts as negative. An item
    goes where the dot product with what is left is highest; of equals, to the first.
    """
    share = items / np.maximum(items.sum(0) / shards, 1e-300)
    left = np.ones((shards, items.shape[1])) * WEIGHTS
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.sum(1))):
        out[i] = np.argmax(left @ share[i])
        left[out[i]] -= share[i] * WEIGHTS
    return out


def sharded(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document with k (the id as a key, see store.key_of), size (UTF-8 bytes plus one), tokens (words), text_crc32,
    shard and slot (gapless from 0 in each shard, in order of k).

    Documents of equal text share a shard unless their group is over half a shard's capacity; then its rows are dealt to
    parts at random (of a fixed seed), which are placed one by one. A null text counts as empty, a null id as the smallest.
    Repeated rows get slots of their own. An empty table gives no rows. Other columns aren't read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    docs = docs.select(key_of(id_column).alias("k"), text.alias("text"))
    rows = docs.select(
        "k",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.greatest(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1, F.lit(1)).cast("long").alias("tokens"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("g"),
        # Tells rows apart that are equal in all else, ids included.
        F.rand(7).alias("tie"),
    )
    rows = written(rows, "sizes")
    total = rows.agg(*(F.sum(c).alias(c) if c != "rows" else F.count("*").alias(c) for c in DIMENSIONS)).first()
    capacity = {c: max(1, (total[c] or 0)) / shards for c in DIMENSIONS}
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy("g").agg(*sums)
    share = F.greatest(*(F.col(c) / F.lit(float(capacity[c])) for c in DIMENSIONS))
    # Shares sum to shards in each dimension: fewer than 3 * HEAVY * shards groups are heavy.
    heavy = groups.filter(share > 1 / HEAVY).select("g", F.when(share > 0.5, F.ceil(share * PARTS * 2)).otherwise(1).cast("int").alias("parts"))
    heavy = written(heavy, "heavy")
    # An item is a heavy group's part or a bundle of light groups.
    item = rows.join(F.broadcast(heavy), "g", "left").select(
        "k", "size", "tokens", "text_crc32", "tie", F.when(F.col("parts").isNotNull(), F.struct(F.lit(True).alias("heavy"), F.col("g").alias("of"), F.floor(F.col("tie") * F.col("parts")).cast("long").alias("part"))).otherwise(F.struct(F.lit(False).alias("heavy"), F.pmod("g", F.lit(BUNDLES * shards)).cast("long").alias("of"), F.lit(0).cast("long").alias("part"))).alias("item")
    )
    bins = item.groupBy("item").agg(*sums).orderBy("item").collect()
    placed = pack(np.array([[b[c] for c in DIMENSIONS] for b in bins], dtype=float).reshape(-1, 3), shards)
    where = docs.sparkSession.createDataFrame([(b["item"]["heavy"], b["item"]["of"], b["item"]["part"], int(s)) for b, s in zip(bins, placed)], "heavy boolean, of long, part long, shard int")
    where = where.select(F.struct("heavy", "of", "part").alias("item"), "shard")
    # As many rows as bins: bounded by the constants above.
    found = dense_index(item.join(F.broadcast(where), "item").drop("item"), "shard", "k", "size", "text_crc32", "tie", out="slot")
    discard(rows, heavy)
    return found.select("k", "size", "tokens", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 3: the law `bytes`, 16 shards, all documents."""
    found = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return found.select(id_of("k").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
