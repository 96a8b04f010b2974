"""The registered queries over the given tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions import sequence as seqf
from strandgraph.functions import vectors as vec
from strandgraph.operators import attention as att
from strandgraph.operators import embed, graph, hierarchy, overlay, scoring, sketch_index
from strandgraph.operators import sketch as sk
from strandgraph.plans import standins as st
from strandgraph.plans.lineage import cut, shared_folder
from strandgraph.plans.standins import table
from strandgraph.sources import fasta, sinks, tables
from strandgraph.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Sequences


@query(f"SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, trim(regexp_replace(translate(upper({st.RNA_SQL}), 'U', 'T'), chr(10), '', 'g'), ' ') AS s FROM documents)")
def seq_normalize(spark, d):
    s = table(spark, d, "documents").select("doc_id", seqf.normalize(st.rna(F.col("text"))).alias("s"))
    return s.select("doc_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


def _kmer_sql(k: int, wanted: str) -> str:
    return f"""WITH s AS (SELECT {st.DNA_SQL} AS s FROM documents), k AS (SELECT substring(s, i::BIGINT, {k}) AS kmer FROM (SELECT s, unnest(range(1, greatest(length(s) - {k - 1}, 1) + 1)) AS i FROM s))
    SELECT {wanted} AS kmer, count(*) AS n FROM k GROUP BY 1"""


@query(_kmer_sql(4, "kmer"))
def kmers(spark, d):
    return seqf.kmer_counts(st.sequences(spark, d), "seq", 4)


@query(_kmer_sql(5, "least(kmer, reverse(translate(kmer, 'ACGTNacgtn', 'TGCANtgcan')))"))
def canonical_kmers(spark, d):
    return seqf.kmer_counts(st.sequences(spark, d), "seq", 5).groupBy(seqf.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id AS seq_id, md5(reverse(translate({st.DNA_SQL}, 'ACGTNacgtn', 'TGCANtgcan'))) AS digest FROM documents")
def reverse_complement(spark, d):
    return st.sequences(spark, d).select("seq_id", F.md5(seqf.reverse_complement(F.col("seq"))).alias("digest"))


K, WINDOW, STRIDE, MOST = 4, 50, 30, 8


def _starts_sql(width: int, stride: int, most: int | None) -> str:
    """CTEs that end in b(seq_id, s, picked): starts of the windows of each sequence, `most` at most."""
    picked = "starts" if most is None else f"CASE WHEN len(starts) <= {most} THEN starts ELSE list_transform(range({most}), lambda i: starts[i * len(starts) // {most} + 1]) END"
    return f"""WITH s AS (SELECT doc_id AS seq_id, {st.DNA_SQL} AS s FROM documents), n AS (SELECT *, greatest(length(s) - {K - 1}, 1) AS n FROM s),
    a AS (SELECT *, CASE WHEN n <= {width} THEN [0::BIGINT] ELSE list_concat(range(0, n - {width} + 1, {stride}), CASE WHEN {stride} * ((n - {width}) // {stride} + 1) < n THEN [n - {width}] ELSE []::BIGINT[] END) END AS starts FROM n),
    b AS (SELECT *, {picked} AS picked FROM a)"""


def _windows(spark, d, most=None):
    n = F.greatest(F.length("seq") - K + 1, F.lit(1))
    w = seqf.Windows(F.col("n"), WINDOW, STRIDE, most)
    rows = st.sequences(spark, d).select("seq_id", n.alias("n")).select("seq_id", "n", F.explode(F.sequence(F.lit(0), w.count() - 1)).alias("win_idx"))
    return rows.select("seq_id", F.col("win_idx").cast("long").alias("win_idx"), w.start(F.col("win_idx")).cast("long").alias("start"))


@query(f"{_starts_sql(WINDOW, STRIDE, MOST)} SELECT seq_id, i - 1 AS win_idx, starts[i] AS start FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM a)")
def windows(spark, d):
    return _windows(spark, d)


@query(f"{_starts_sql(WINDOW, STRIDE, MOST)} SELECT seq_id, i - 1 AS win_idx, picked[i] AS start FROM (SELECT *, unnest(range(1, len(picked) + 1)) AS i FROM b)")
def windows_sampled(spark, d):
    """The cap is what this one is about."""
    return _windows(spark, d, MOST)


#: How sequences are embedded: windows side by side over the whole sequence.
TOKENS, STEP = 510, 510
_CUT = f"{_starts_sql(TOKENS, STEP, None)}, w AS (SELECT seq_id, i - 1 AS win_idx, substring(s, picked[i] + 1, {TOKENS + K - 1}) AS t FROM (SELECT *, unnest(range(1, len(picked) + 1)) AS i FROM b))"


@query(f"{_CUT} SELECT seq_id, win_idx, md5(array_to_string(list_transform(range(1, greatest(length(t) - {K - 1}, 1) + 1), lambda i: substring(t, i, {K})), ' ')) AS digest FROM w")
def window_text(spark, d):
    rows = embed.windows(st.sequences(spark, d), K, TOKENS, STEP)
    return rows.select("seq_id", F.col("win_idx").cast("long").alias("win_idx"), F.md5(embed.kmer_text(F.col("text"), K)).alias("digest"))


@query(
    f"""{_CUT} SELECT seq_id, '+' AS strand, win_idx, md5(t) AS digest FROM w UNION ALL
    SELECT seq_id, '-', i - 1, md5(substring(reverse(translate(s, 'ACGTNacgtn', 'TGCANtgcan')), picked[i] + 1, {TOKENS + K - 1})) FROM (SELECT *, unnest(range(1, len(picked) + 1)) AS i FROM b)"""
)
def strand_windows(spark, d):
    """Windows of both strands."""
    rows = embed.windows(st.sequences(spark, d), K, TOKENS, STEP, both_strands=True)
    return rows.select("seq_id", "strand", F.col("win_idx").cast("long").alias("win_idx"), F.md5("text").alias("digest"))


@query(f"{_CUT} SELECT seq_id, win_idx, md5(array_to_string(list_transform(range(1, least(greatest(length(t) - {K - 1}, 1), 130) + 1), lambda i: substring(t, i, {K})), ' ')) AS digest FROM w")
def truncated_tokens(spark, d):
    """A window's tokens as a model of 128 and two marks takes them."""
    rows = embed.windows(st.sequences(spark, d), K, TOKENS, STEP)
    tokens = F.array_join(seqf.truncated(F.split(embed.kmer_text(F.col("text"), K), " "), 128), " ")
    return rows.select("seq_id", F.col("win_idx").cast("long").alias("win_idx"), F.md5(tokens).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[*#+]+$', ''), '[^{seqf.AMINO_ACIDS}]', 'X', 'g')) AS digest FROM documents WHERE text <> ''")
def protein_clean(spark, d):
    return table(spark, d, "documents").filter("text <> ''").select("doc_id", F.md5(seqf.clean_protein(F.col("text"))).alias("digest"))


# Sketches


SKETCH_K, SCALED = 21, 20
_HASH = seqf.kmer_hash_sql("c", SKETCH_K)
_CANONICAL = "least(k, reverse(translate(k, 'ACGTNacgtn', 'TGCANtgcan'))) AS c"
_SKETCH = f"""WITH s AS (SELECT doc_id AS id, {st.DNA_SQL} AS s FROM documents),
k AS (SELECT id, substring(s, i::BIGINT, {SKETCH_K}) AS k FROM (SELECT id, s, unnest(range(1, length(s) - {SKETCH_K - 1} + 1)) AS i FROM s WHERE length(s) >= {SKETCH_K})),
sk AS (SELECT id, hash, count(*) AS abund FROM (SELECT id, {_HASH} AS hash FROM (SELECT id, {_CANONICAL} FROM k)) WHERE hash < {(1 << 60) // SCALED} GROUP BY ALL),
sz AS (SELECT id, count(*) AS n FROM sk GROUP BY 1),
pairs AS (SELECT a.id AS query_id, b.id AS ref_id, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS score FROM sk a JOIN sk b USING (hash) JOIN sz x ON x.id = a.id JOIN sz y ON y.id = b.id WHERE a.id <> b.id GROUP BY 1, 2)"""


def _sketches(spark, d):
    return sk.sketch(st.sequences(spark, d), SKETCH_K, SCALED, "seq_id")


def _sketch_classes(spark, d):
    return sk.classes_of_sets(sk.sketch_sets(st.sequences(spark, d), SKETCH_K, SCALED, "seq_id"))


def _classes(spark, d, threshold=0.8):
    """Classes of equal sketches, and the pairs of classes."""
    found = _sketch_classes(spark, d)
    return found, cut(sk.similar_classes(found, threshold), "pairs")


def _pairs(spark, d, threshold=0.8):
    return sk.expanded(*_classes(spark, d, threshold))


@query(f"{_SKETCH} SELECT id, hash, abund FROM sk")
def sketch(spark, d):
    return _sketches(spark, d)


@query(f"{_SKETCH} SELECT query_id, ref_id, round(score, 6) AS score FROM pairs WHERE score >= 0.8")
def jaccard_pairs(spark, d):
    return _pairs(spark, d).select("query_id", "ref_id", F.round("score", 6).alias("score"))


@query(f"{_SKETCH} SELECT least(query_id, ref_id) AS src_id, greatest(query_id, ref_id) AS dst_id, 'sequence-sequence' AS edge_type, round(score, 6) AS weight FROM pairs WHERE score >= 0.8")
def similarity_edges(spark, d):
    return sk.similarity_edges(_pairs(spark, d), 0.8, "sequence-sequence").withColumn("weight", F.round("weight", 6))


@query(
    f"""{_SKETCH}, q AS (SELECT item_id AS query_id, {st.DNA_SQL} AS s FROM benchmark), qk AS (SELECT query_id, substring(s, i::BIGINT, {SKETCH_K}) AS k FROM (SELECT query_id, s, unnest(range(1, length(s) - {SKETCH_K - 1} + 1)) AS i FROM q WHERE length(s) >= {SKETCH_K})),
    qs AS (SELECT DISTINCT query_id, hash FROM (SELECT query_id, {_HASH} AS hash FROM (SELECT query_id, {_CANONICAL} FROM qk)) WHERE hash < {(1 << 60) // SCALED}),
    qn AS (SELECT query_id, count(*) AS n FROM qs GROUP BY 1), p AS (SELECT query_id, id AS ref_id, count(*) AS c FROM qs JOIN sk USING (hash) GROUP BY 1, 2)
    SELECT query_id, ref_id, round(c / (qn.n + sz.n - c), 6) AS score FROM p JOIN qn USING (query_id) JOIN sz ON sz.id = ref_id WHERE c / (qn.n + sz.n - c) >= 0.05"""
)
def query_pairs(spark, d):
    """Benchmark items as queries against a library of all documents' sketches."""
    q = table(spark, d, "benchmark").select("item_id", st.dna(F.col("text")).alias("seq"))
    path = shared_folder(spark, "sketch-index")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    sketch_index.add_sketches(_sketches(spark, d), name, path)
    return sketch_index.probe(sk.sketch(q, SKETCH_K, SCALED, "item_id"), name, 0.05).select("query_id", "ref_id", F.round("score", 6).alias("score"))


_CLASSES = f"""{_SKETCH}, sets AS (SELECT id, list(hash ORDER BY hash) AS h FROM sk GROUP BY 1), members AS (SELECT id, min(id) OVER (PARTITION BY h) AS class_id FROM sets)"""


@query(f"{_CLASSES} SELECT id, class_id FROM members")
def sketch_classes(spark, d):
    """Each sequence's class of equal sketches, by the class's smallest id."""
    return _sketch_classes(spark, d).members


@query(f"{_CLASSES} SELECT query_id AS class_a, ref_id AS class_b, round(score, 6) AS score FROM pairs WHERE score >= 0.8 AND query_id < ref_id AND query_id IN (SELECT class_id FROM members) AND ref_id IN (SELECT class_id FROM members)")
def class_pairs(spark, d):
    """Pairs of classes; with sketch_classes these say what jaccard_pairs does, in rows that don't grow with the square of copies."""
    return _classes(spark, d)[1].select("class_a", "class_b", F.round("score", 6).alias("score"))


@query(
    f"""{_SKETCH}, best AS (SELECT query_id, ref_id, score FROM pairs WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) = 1)
    SELECT d.doc_id AS query_id, b.ref_id, coalesce(r.lang, 'unknown_' || d.doc_id) AS top_label, round(b.score, 6) AS score FROM documents d LEFT JOIN best b ON b.query_id = d.doc_id LEFT JOIN documents r ON r.doc_id = b.ref_id"""
)
def best_match(spark, d):
    """The flagship: each document's most similar other one, and that one's label, or a fallback."""
    docs = table(spark, d, "documents")
    best = sk.best_of_classes(*_classes(spark, d, 0.5))
    labels = docs.select(F.col("doc_id").alias("ref_id"), "lang")
    rows = docs.select(F.col("doc_id").alias("query_id")).join(best, "query_id", "left").join(labels, "ref_id", "left")
    return rows.select("query_id", "ref_id", F.coalesce("lang", F.concat(F.lit("unknown_"), F.col("query_id").cast("string"))).alias("top_label"), F.round("score", 6).alias("score"))


@query()
def lsh_pairs(spark, d):
    """Pairs of classes by bands of minima: approximate, so tests hold it against class_pairs."""
    return sk.lsh_classes(_sketch_classes(spark, d), 0.8).select("class_a", "class_b", F.round("score", 6).alias("score"))


# Files


@query(f"SELECT 'doc' || doc_id AS seq_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, {st.DNA_SQL} AS s FROM documents)")
def fasta_roundtrip(spark, d):
    path = shared_folder(spark, "fasta")
    fasta.write_fasta(st.sequences(spark, d).select(F.concat(F.lit("doc"), F.col("seq_id").cast("string"), F.lit(" made")).alias("seq_id"), "seq"), path)
    return fasta.read_fasta(spark, path, (".txt",)).select("seq_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query(f"SELECT 'doc' || doc_id AS protein_id, length(s) AS n, md5(regexp_replace(s, '[^{seqf.AMINO_ACIDS}]', 'X', 'g')) AS digest FROM (SELECT doc_id, {st.DNA_SQL} AS s FROM documents) WHERE s <> ''")
def faa_scan(spark, d):
    path = shared_folder(spark, "faa")
    fasta.write_fasta(st.sequences(spark, d).select(F.concat(F.lit("doc"), F.col("seq_id").cast("string")).alias("seq_id"), F.when(F.col("seq") != "", F.concat("seq", F.lit("*"))).otherwise("").alias("seq")), path)
    return fasta.read_proteins(spark, path, (".txt",)).select("protein_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query(f"{_SKETCH} SELECT ref_id AS existing_id, round(score, 6) AS score FROM pairs WHERE score >= 0.8")
def similarity_tsv(spark, d):
    path = shared_folder(spark, "tsv")
    sinks.write_similarities(_pairs(spark, d).select(F.col("ref_id").alias("existing_id"), "score"), path)
    return fasta.read_similarities(spark, path).select(F.col("existing_id").cast("long").alias("existing_id"), "score")


# Vectors


_VALUES = "SELECT vec_id, label, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


def _spread(df, *keys, column="embedding"):
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).select(*keys, F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH v AS ({_VALUES}), m AS (SELECT label, pos, avg(v) AS v FROM v GROUP BY 1, 2) SELECT label, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m")
def mean_embedding(spark, d):
    return _spread(embed.group_vectors(table(spark, d, "embeddings"), "label"), "label")


@query(f"WITH v AS ({_VALUES}), s AS (SELECT label, vec_id % 3 AS strand, pos, avg(v) AS v FROM v GROUP BY 1, 2, 3), m AS (SELECT label, pos, avg(v) AS v FROM s GROUP BY 1, 2) SELECT label AS seq_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m")
def two_level_mean(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("seq_id"), (F.col("vec_id") % 3).alias("strand"), "embedding")
    return _spread(embed.sequence_vectors(rows), "seq_id")


@query(f"WITH v AS ({_VALUES}) SELECT vec_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM v")
def l2_normalize(spark, d):
    return _spread(table(spark, d, "embeddings").select("vec_id", vec.l2_normalize(F.col("embedding")).alias("embedding")), "vec_id")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = a.toDF("b", "y")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vec.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS idx, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS d FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, idx, round(1 / (1 + exp(-d * exp(0.5))), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, idx) AS rank FROM p QUALIFY rank <= 3"""
)
def score_topk(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    # The stated set of queries, against all rows but the query's own.
    top = scoring.top_candidates(rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "idx"), 0.5, 3, but_itself=True)
    return top.select("query_id", "idx", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Hierarchies


def _tree(spark, d):
    customers = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("taxid"), (F.col("c_nationkey") + 100).cast("long").alias("parent"), F.col("c_name").alias("name"), F.lit(" Customer ").alias("rank"))
    nations = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("taxid"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("name"), F.lit("NATION").alias("rank"))
    regions = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("taxid"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"), F.lit("region").alias("rank"))
    return fasta.taxonomy(customers.unionByName(nations).unionByName(regions))


@query(
    """SELECT c_custkey + 1000 AS taxid, coalesce(r_name, 'NA') AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT n_nationkey + 100, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT -1, 'NA'"""
)
def ancestor_rank(spark, d):
    tree = cut(_tree(spark, d), "tree")
    starts = tree.filter("rank <> 'region'").select("taxid").unionByName(tree.limit(1).select(F.lit(-1).cast("long").alias("taxid")))
    return hierarchy.ancestors(tree, starts, "region")


@query(ORACLE["ancestor_rank"])
def ancestor_paths(spark, d):
    """The same by paths: customers are appended as leaves to the paths of nations and regions."""
    tree = cut(_tree(spark, d), "tree")
    leaf = F.col("rank") == "customer"
    labels = hierarchy.with_leaves(hierarchy.paths(tree.filter(~leaf)), tree.filter(leaf))
    starts = tree.filter("rank <> 'region'").select("taxid").unionByName(tree.limit(1).select(F.lit(-1).cast("long").alias("taxid")))
    return hierarchy.ancestors_by_path(cut(labels, "paths"), tree, starts, "region")


@query("SELECT doc_id AS idx, coalesce(quality, -1) AS taxid, coalesce(n_name, 'unknown_' || coalesce(quality::VARCHAR, '-1')) AS species FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN nation ON n_nationkey = quality")
def species_label(spark, d):
    """Labels cover some of the documents only; the others have no name."""
    species = table(spark, d, "nation").select(F.col("n_nationkey").alias("taxid"), F.col("n_name").alias("species"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("idx")).join(table(spark, d, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").alias("taxid")), "idx", "left")
    return hierarchy.with_species(rows.fillna({"taxid": -1}), species).select("idx", "taxid", "species")


@query(
    """SELECT c_custkey AS idx, c_custkey AS host, coalesce(taxid, -1) AS taxid FROM customer LEFT JOIN
    (SELECT o_custkey AS host, nullif(o_orderkey % 7, 0) AS taxid FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON host = c_custkey"""
)
def host_taxid(spark, d):
    """Customers without orders are hosts that the catalog lacks; some first rows have no taxid."""
    catalog = table(spark, d, "orders").select(F.col("o_custkey").alias("host"), F.nullif(F.col("o_orderkey") % 7, F.lit(0)).alias("taxid"), "o_orderdate", "o_orderkey")
    hosts = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_custkey").alias("host"))
    return hierarchy.host_taxids(hosts, catalog, F.struct("o_orderdate", "o_orderkey"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_dedupe(spark, d):
    return hierarchy.first_by(table(spark, d, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_dedupe(spark, d):
    return hierarchy.last_by(table(spark, d, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


# Graphs


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END AS t FROM orders)
    SELECT 's' || o_custkey AS id, o_orderkey AS position, 's' || o_custkey || CASE WHEN t = 0 THEN '' ELSE '_' || t END AS assigned_id FROM r"""
)
def unique_ids(spark, d):
    orders, base = table(spark, d, "orders"), F.concat(F.lit("s"), F.col("c_custkey").cast("string"))
    customers = table(spark, d, "customer")
    taken = customers.filter("c_custkey % 3 = 0").select(base.alias("id")).unionByName(customers.filter("c_custkey % 6 = 0").select(F.concat(base, F.lit("_1")).alias("id")))
    return graph.unique_ids(orders.select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("position")), taken)


@query("SELECT o_orderstatus AS kind, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders")
def assign_index(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return graph.dense_index(rows, "kind", "o_totalprice", "id").select("kind", "id", "idx")


def _nodes(spark, d):
    """Customers of even number and all parts, as nodes."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    empty = F.array().cast("array<double>")
    rows = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.lit("customer").alias("ntype"), pad("c_custkey").alias("id")).unionByName(table(spark, d, "part").select(F.lit("part").alias("ntype"), pad("p_partkey").alias("id")))
    return graph.dense_index(rows, "ntype", "id").select("ntype", "idx", "id", empty.alias("x"))


def _new_nodes(spark, d):
    empty = F.array().cast("array<double>")
    return table(spark, d, "customer").filter("c_custkey % 2 = 1").select(F.lit("customer").alias("ntype"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("id"), empty.alias("x"))


_NODES = """WITH old AS (SELECT 'customer' AS ntype, lpad(c_custkey::VARCHAR, 12, '0') AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'part', lpad(p_partkey::VARCHAR, 12, '0') FROM part),
o AS (SELECT ntype, id, row_number() OVER (PARTITION BY ntype ORDER BY id) - 1 AS idx FROM old),
n AS (SELECT 'customer' AS ntype, lpad(c_custkey::VARCHAR, 12, '0') AS id FROM customer WHERE c_custkey % 2 = 1),
nodes AS (SELECT ntype, id, idx FROM o UNION ALL SELECT ntype, id, row_number() OVER (PARTITION BY ntype ORDER BY id) + (SELECT max(idx) FROM o x WHERE x.ntype = n.ntype) FROM n)"""


@query(f"{_NODES} SELECT ntype, id, idx FROM nodes")
def attach_nodes(spark, d):
    return graph.attach_nodes(cut(_nodes(spark, d), "nodes"), _new_nodes(spark, d)).select("ntype", "id", "idx")


def _id_edges(spark, d):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    return st.purchases(spark, d).select(F.lit("customer").alias("src_type"), F.lit("buys").alias("rel"), F.lit("part").alias("dst_type"), pad("src").alias("src_id"), pad("dst").alias("dst_id"))


_BUYS = "b AS (SELECT DISTINCT lpad(o_custkey::VARCHAR, 12, '0') AS s, lpad(l_partkey::VARCHAR, 12, '0') AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"{_NODES}, {_BUYS} SELECT s AS src_id, t AS dst_id, x.idx AS src, y.idx AS dst FROM b JOIN o x ON x.ntype = 'customer' AND x.id = s JOIN o y ON y.ntype = 'part' AND y.id = t")
def resolve_edges(spark, d):
    return graph.resolved(_id_edges(spark, d), cut(_nodes(spark, d), "nodes")).select("src_id", "dst_id", "src", "dst")


@query(
    f"""{_NODES}, {_BUYS}, e AS (SELECT x.idx AS src, y.idx AS dst FROM b JOIN nodes x ON x.ntype = 'customer' AND x.id = s JOIN nodes y ON y.ntype = 'part' AND y.id = t)
    SELECT 'customer' AS src_type, 'buys' AS rel, 'part' AS dst_type, src, dst FROM e UNION ALL SELECT 'part', 'bought_by', 'customer', dst, src FROM e"""
)
def attach_edges(spark, d):
    old = cut(_nodes(spark, d), "nodes")
    everything = cut(graph.attach_nodes(old, _new_nodes(spark, d)), "nodes")
    wanted = cut(_id_edges(spark, d), "id-edges")
    before = graph.both_directions(graph.resolved(wanted, old), "bought_by")
    after = graph.resolved(wanted.join(_new_nodes(spark, d).select(F.col("id").alias("src_id")), "src_id", "left_semi"), everything)
    return graph.attach_edges(before, graph.both_directions(after, "bought_by"))


@query(f"{_NODES} SELECT ntype, id FROM o WHERE ntype = 'customer' AND id::BIGINT % 4 = 0")
def id_conflicts(spark, d):
    proposed = table(spark, d, "customer").filter("c_custkey % 4 <> 2").select(F.lit("customer").alias("ntype"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("id"))
    return graph.conflicts(_nodes(spark, d), proposed)


@query(
    """SELECT c_custkey AS query_id, 1 AS query_nodes, count(DISTINCT o_orderkey) AS protein_nodes, count(l_orderkey) AS similarity_proposed, count(CASE WHEN l_suppkey % 2 = 0 THEN 1 END) AS similarity_attached, count(DISTINCT o_orderkey) AS encodes_edges, count(DISTINCT o_orderkey) AS encoded_by_edges
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def attach_counts(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey")
    lines = orders.join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.attach_counts(table(spark, d, "customer").select(F.col("c_custkey").alias("query_id")), orders, lines, lines.filter("l_suppkey % 2 = 0"))


@query(
    f"""{_NODES}, {_BUYS} SELECT 'customer' AS src_type, 'buys' AS rel, 'part' AS dst_type, x.idx AS src, y.idx AS dst, x.id AS src_id, y.id AS dst_id FROM b JOIN o x ON x.ntype = 'customer' AND x.id = s JOIN o y ON y.ntype = 'part' AND y.id = t"""
)
def graph_store(spark, d):
    """The graph written by type and relation, read again, and its edges named by their ends."""
    nodes = cut(_nodes(spark, d), "nodes")
    path = shared_folder(spark, "graph")
    tables.write_graph(nodes, graph.resolved(_id_edges(spark, d), nodes).select(*graph.RELATION, "src", "dst"), path)
    again, edges = tables.read_graph(spark, path)
    names = again.select("ntype", "idx", "id")
    return edges.join(names.toDF("src_type", "src", "src_id"), ["src", "src_type"]).join(names.toDF("dst_type", "dst", "dst_id"), ["dst", "dst_type"]).select(*graph.RELATION, "src", "dst", "src_id", "dst_id")


@query(
    """WITH q AS (SELECT c_custkey, row_number() OVER (ORDER BY lpad(c_custkey::VARCHAR, 12, '0')) + (SELECT count(*) FROM supplier) - 1 AS idx FROM customer),
    p AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY lpad(o_orderkey::VARCHAR, 12, '0')) - 1 AS idx FROM orders),
    s AS (SELECT s_suppkey, row_number() OVER (ORDER BY lpad(s_suppkey::VARCHAR, 12, '0')) - 1 AS idx FROM supplier)
    SELECT 'interacts' AS rel, s.idx AS src, q.idx AS dst FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN q ON c_custkey = o_custkey JOIN s ON s_suppkey = l_suppkey
    UNION ALL SELECT 'encodes', q.idx, p.idx FROM p JOIN q ON c_custkey = o_custkey UNION ALL SELECT 'encoded_by', p.idx, q.idx FROM p JOIN q ON c_custkey = o_custkey"""
)
def attach_batch(spark, d):
    """All of a batch's queries attached in one plan: customers as queries, orders as their proteins, suppliers as the graph, and
    whom a customer bought from as similar."""
    pad = lambda c, p="": F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 12, "0"))
    empty = F.array().cast("array<double>")
    old = cut(graph.dense_index(table(spark, d, "supplier").select(F.lit("phage").alias("ntype"), pad("s_suppkey", "s").alias("id"), empty.alias("x")), "ntype", "id").select("ntype", "idx", "id", "x"), "nodes")
    orders = table(spark, d, "orders")
    queries = table(spark, d, "customer").select(pad("c_custkey", "t").alias("query_id"), empty.alias("x"))
    proteins = orders.select(pad("o_custkey", "t").alias("query_id"), pad("o_orderkey").alias("protein_id"), empty.alias("x"))
    bought = orders.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    near = bought.select(pad("o_custkey", "t").alias("query_id"), pad("l_suppkey", "s").alias("src_id"), pad("o_custkey", "t").alias("dst_id"))
    none = near.limit(0).select(F.lit("").alias("src_type"), F.lit("").alias("rel"), F.lit("").alias("dst_type"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    _, edges, _ = graph.attach_queries(old, none, queries, proteins, near)
    return edges.select("rel", "src", "dst")


@query("SELECT name AS ntype, n, (SELECT max(len(embedding)) FROM embeddings) AS width FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part)")
def feature_widths(spark, d):
    of = lambda name, key: st.features(spark, d, table(spark, d, name).select(F.col(key).alias("idx"))).withColumn("ntype", F.lit(name))
    return graph.checked_sizes(of("customer", "c_custkey").unionByName(of("part", "p_partkey"))).select("ntype", F.col("count").alias("n"), "width")


# Attention


@query("SELECT l_orderkey, l_linenumber, round(exp(l_discount * 10) / sum(exp(l_discount * 10)) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def segment_softmax(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("logit"))
    w = att.segment_softmax(rows, ["l_orderkey"], "logit")
    total = w.groupBy("l_orderkey").agg(F.sum("weight").alias("total"))
    return w.join(total, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(F.col("weight") / F.col("total"), 6).alias("weight"))


def attention(shift: int, width: int, dim: int = st.DIM) -> att.Attention:
    n = st.HEADS * dim
    return att.Attention(st.weights(n, width, shift), st.weights(n, width, shift + 1), st.weights(st.HEADS, dim, shift + 2), st.weights(1, dim, shift + 3)[0])


#: Where the gate's weights come from: shifts of its first map, that one's bias, and its second.
GATE = (8, 4, 9)


def gate(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return st.weights(3, dim, GATE[0]), st.weights(1, 3, GATE[1])[0], st.weights(1, 3, GATE[2])[0]


def _side(spark, d, name, key):
    return st.features(spark, d, table(spark, d, name).select(F.col(key).alias("idx")))


def _out_rows(df):
    return df.select("idx", F.posexplode("out").alias("pos", "v")).select("idx", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


def _two_relations(spark, d):
    parts, width = cut(_side(spark, d, "part", "p_partkey"), "parts"), st.feature_width(spark, d)
    buys = att.attended(st.purchases(spark, d), _side(spark, d, "customer", "c_custkey"), parts, attention(0, width))
    supplied = att.attended(st.supplies(spark, d), _side(spark, d, "supplier", "s_suppkey"), parts, attention(5, width))
    return parts, buys, supplied


_TWO = f"WITH {st.FEATURES_SQL}, {st.attended_sql('a', 'buys', 'cust', 'prt', 0)}, {st.attended_sql('b', 'supplies', 'supp', 'prt', 5)}"


@query(f"WITH {st.FEATURES_SQL}, {st.attended_sql('a', 'buys', 'cust', 'prt', 0)} SELECT idx, pos, round(v, 6) AS value FROM a")
def gat_layer(spark, d):
    return _out_rows(att.attended(st.purchases(spark, d), _side(spark, d, "customer", "c_custkey"), _side(spark, d, "part", "p_partkey"), attention(0, st.feature_width(spark, d))))


@query(f"{_TWO} SELECT idx, pos, round(greatest(a.v + b.v, 0), 6) AS value FROM a JOIN b USING (idx, pos)")
def gat_sum(spark, d):
    _, buys, supplied = _two_relations(spark, d)
    return _out_rows(att.summed(buys.unionByName(supplied)))


@query(f"{_TWO}, {st.gated_sql('g', ['a', 'b'], st.DIM)} SELECT idx, pos, round(v, 6) AS value FROM g")
def relation_gate(spark, d):
    _, buys, supplied = _two_relations(spark, d)
    return _out_rows(att.gated(buys.unionByName(supplied), *gate(st.DIM)))


@query(
    """SELECT l_orderkey, l_linenumber, round(2.0 * CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_quantity END, 6) AS first, round(2.0 * CASE WHEN l_linenumber % 3 = 2 THEN l_discount ELSE 1 END, 6) AS second FROM lineitem"""
)
def edge_attr_coerce(spark, d):
    rows = table(spark, d, "lineitem")
    wide = F.array("l_quantity", "l_discount", "l_tax")
    attr = F.when(F.col("l_linenumber") % 3 == 1, F.array("l_quantity")).when(F.col("l_linenumber") % 3 == 2, wide)
    edges = rows.select("l_orderkey", "l_linenumber", F.lit("a").alias("src_type"), F.lit("r").alias("rel"), F.lit("b").alias("dst_type"), attr.alias("attr"))
    logs = table(spark, d, "region").limit(1).select(F.lit("a").alias("src_type"), F.lit("r").alias("rel"), F.lit("b").alias("dst_type"), F.log(F.lit(2.0)).alias("log_weight"))
    out = att.edge_weights(edges, logs, 2)
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("attr")[0], 6).alias("first"), F.round(F.col("attr")[1], 6).alias("second"))


def model(width: int) -> tuple[dict, list[att.Layer], tuple[np.ndarray, np.ndarray]]:
    """A small model with closed-form weights over customers, parts and suppliers: features of `width` numbers become states of
    HIDDEN, which two layers update."""
    n = st.HIDDEN
    relations = {("customer", "buys", "part"): 0, ("part", "bought_by", "customer"): 1, ("supplier", "supplies", "part"): 2, ("part", "supplied_by", "supplier"): 3}
    one = att.Layer({r: attention(shift, n, n) for r, shift in relations.items()}, *gate(n))
    inputs = {k: (st.weights(n, width, i), st.weights(1, n, i)[0]) for i, k in enumerate(("customer", "part", "supplier"))}
    return inputs, [one, one], (st.weights(n, n, 6), st.weights(1, n, 7)[0])


def _graph(spark, d):
    """nodes(ntype, idx, x) with whole vectors, as wide as they are, and edges in both directions, of customers, parts and suppliers."""
    nodes = None
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        side = _side(spark, d, name, key).select(F.lit(name).alias("ntype"), "idx", "x")
        nodes = side if nodes is None else nodes.unionByName(side)
    kind = lambda e, s, r, t: e.select(F.lit(s).alias("src_type"), F.lit(r).alias("rel"), F.lit(t).alias("dst_type"), "src", "dst")
    edges = graph.both_directions(kind(st.purchases(spark, d), "customer", "buys", "part"), "bought_by").unionByName(graph.both_directions(kind(st.supplies(spark, d), "supplier", "supplies", "part"), "supplied_by"))
    return cut(nodes, "nodes"), cut(edges, "edges")


def _embedded(spark, d):
    inputs, layers, final = model(st.feature_width(spark, d))
    return {k: cut(v, "state") for k, v in att.embedded(*_graph(spark, d), inputs, layers, final).items()}


def _spread_states(states):
    """ntype, idx, pos, value of states by type."""
    parts = None
    for kind, df in states.items():
        rows = df.select(F.lit(kind).alias("ntype"), "idx", F.posexplode("x").alias("pos", "value")).select("ntype", "idx", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


_MODEL = st.model_sql()


@query(f"{_MODEL} " + " UNION ALL ".join(f"SELECT '{name}' AS ntype, idx, i - 1 AS pos, round(x[i], 6) AS value FROM (SELECT *, unnest(range(1, {st.HIDDEN + 1})) AS i FROM {kind}_z)" for kind, name in (("cust", "customer"), ("prt", "part"), ("supp", "supplier"))))
def gat_embed(spark, d):
    return _spread_states(_embedded(spark, d))


@query(f"{_MODEL} " + " UNION ALL ".join(f"SELECT '{name}' AS ntype, idx, i - 1 AS pos, round(x[i], 6) AS value FROM (SELECT *, unnest(range(1, {st.HIDDEN + 1})) AS i FROM {kind}_z)" for kind, name in (("cust", "customer"), ("prt", "part"), ("supp", "supplier"))))
def incremental_embed(spark, d):
    """Every second customer is attached to the graph of the others, whose states are kept; the frontier alone is made anew."""
    nodes, edges = _graph(spark, d)
    new = (F.col("ntype") == "customer") & (F.col("idx") % 2 == 1)
    end = F.when(F.col("src_type") == "customer", F.col("src")).when(F.col("dst_type") == "customer", F.col("dst")).otherwise(0)
    inputs, layers, final = model(st.feature_width(spark, d))
    frozen = overlay.freeze(nodes.filter(~new), edges.filter(end % 2 == 0), inputs, layers)
    one = F.lit("all").alias("query")
    attached = overlay.attach(frozen, nodes.filter(new).select(one, "ntype", "idx", "x"), edges.filter(end % 2 == 1).select(one, *graph.RELATION, "src", "dst"))
    return _spread_states({k: v.select("idx", att.project(*final, "length 1")("x").alias("x")) for k, v in overlay.shared_states(frozen, attached).items()})


@query(f"{st.isolated_sql()} SELECT idx AS query_id, i - 1 AS pos, round(x[i], 6) AS value FROM (SELECT *, unnest(range(1, {st.HIDDEN + 1})) AS i FROM cust_z)")
def isolated_embed(spark, d):
    """Each customer by itself on the graph of parts and suppliers: none hears of another one."""
    nodes, edges = _graph(spark, d)
    customer = (F.col("src_type") == "customer") | (F.col("dst_type") == "customer")
    name = F.when(F.col("src_type") == "customer", F.col("src")).otherwise(F.col("dst")).alias("query")
    inputs, layers, final = model(st.feature_width(spark, d))
    new = nodes.filter("ntype = 'customer'").select(F.col("idx").alias("query"), "ntype", "idx", "x")
    runs = overlay.isolated(nodes.filter("ntype <> 'customer'"), edges.filter(~customer), new, edges.filter(customer).select(name, *graph.RELATION, "src", "dst"), inputs, layers, wanted={"customer": new.select("query", "idx")})
    out = None
    for _, _, attached in runs:
        rows = attached["customer"].select(F.col("query").alias("query_id"), att.project(*final, "length 1")("x").alias("x"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("query_id", F.posexplode("x").alias("pos", "value")).select("query_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


# Ties: dot products to 12 decimals, the smaller idx first.
_BEST = """best AS (SELECT c.idx AS query_id, s.idx, round(list_dot_product(c.x, s.x), 12) AS d FROM cust_z c CROSS JOIN supp_z s QUALIFY row_number() OVER (PARTITION BY c.idx ORDER BY d DESC, s.idx) = 1)"""


def _best(spark, d):
    state = _embedded(spark, d)
    return scoring.top_candidates(state["customer"].withColumnRenamed("idx", "query_id"), state["supplier"], 1.0, 1)


@query(f"{_MODEL}, {_BEST} SELECT query_id, idx, round(1 / (1 + exp(-d * exp(1))), 6) AS score FROM best")
def score_hosts(spark, d):
    return _best(spark, d).select("query_id", "idx", F.round("score", 6).alias("score"))


@query(f"{_MODEL} SELECT src, dst, round(list_dot_product(a.x, b.x) * exp(1), 6) AS logit FROM buys JOIN cust_z a ON a.idx = src JOIN prt_z b ON b.idx = dst")
def link_decode(spark, d):
    state = _embedded(spark, d)
    out = scoring.decoded_pairs(st.purchases(spark, d), state["customer"], state["part"])
    return out.select("src", "dst", F.round("logit", 6).alias("logit"))


_BOTH_ENDS = "list_concat(a.x, b.x)"
_MLP = f"list_sum(list_transform(range(6), lambda k: {st.weight_sql('0', 'k', 4)} * greatest(h[k + 1], 0))) + 0.25"


@query(
    f"""WITH {st.FEATURES_SQL}, h AS (SELECT src, dst, list_transform(range(6), lambda i: list_sum(list_transform(range(len(a.x) + len(b.x)), lambda j: {st.weight_sql('i', 'j', 2)} * {_BOTH_ENDS}[j + 1])) + {st.weight_sql('0', 'i', 3)}) AS h FROM buys JOIN cust a ON a.idx = src JOIN prt b ON b.idx = dst)
    SELECT src, dst, round({_MLP}, 6) AS logit FROM h"""
)
def link_decode_network(spark, d):
    """The decoder of two linear maps, over both ends' features."""
    width = 2 * st.feature_width(spark, d)
    out = scoring.decoded_by_network(st.purchases(spark, d), _side(spark, d, "customer", "c_custkey"), _side(spark, d, "part", "p_partkey"), st.weights(6, width, 2), st.weights(1, 6, 3)[0], st.weights(1, 6, 4)[0], 0.25)
    return out.select("src", "dst", F.round("logit", 6).alias("logit"))


@query(
    f"""{_MODEL}, {_BEST} SELECT query_id, coalesce(n_name, 'unknown_' || (coalesce(s_nationkey + 100, -1))) AS top_species, coalesce(r_name, 'NA') AS top_genus, round(1 / (1 + exp(-d * exp(1))), 6) AS score
    FROM best LEFT JOIN supplier ON s_suppkey = idx LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
)
def predict_labels(spark, d):
    hosts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), (F.col("s_nationkey") + 100).cast("long").alias("taxid"))
    species = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("taxid"), F.col("n_name").alias("species"))
    genera = hierarchy.ancestors(cut(_tree(spark, d), "tree"), hosts, "region")
    return hierarchy.labelled(_best(spark, d), hosts, species, genera)


# Embedding and increments


_FREQUENCIES = f"""{_CUT},
l AS (SELECT a || c AS two, row_number() OVER (ORDER BY a, c) - 1 AS pos FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS c)),
c AS (SELECT seq_id, win_idx, substring(t, j::BIGINT, 2) AS two, length(t) - 1 AS n FROM (SELECT *, unnest(range(1, length(t))) AS j FROM w)),
f AS (SELECT seq_id, win_idx, two, count(*) / any_value(n) AS v FROM c GROUP BY 1, 2, 3),
m AS (SELECT x.seq_id, l.pos, coalesce(y.v, 0) / x.k AS v FROM (SELECT seq_id, count(*) AS k FROM w GROUP BY 1) x CROSS JOIN l LEFT JOIN (SELECT seq_id, two, sum(v) AS v FROM f GROUP BY 1, 2) y ON y.seq_id = x.seq_id AND y.two = l.two)
SELECT seq_id, pos, round(CASE WHEN sum(v * v) OVER p > 0 THEN v / sqrt(sum(v * v) OVER p) ELSE v END, 6) AS value FROM m WINDOW p AS (PARTITION BY seq_id)"""


@query(_FREQUENCIES)
def embed_batches(spark, d):
    wins = embed.windows(st.sequences(spark, d), K, TOKENS, STEP)
    vectors = embed.embed_batches(wins, embed.base_frequencies(2), ["seq_id", "strand", "win_idx"])
    return _spread(embed.sequence_vectors(vectors), "seq_id")


_LETTERS = "', '".join(seqf.AMINO_ACIDS)


@query(
    f"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(translate(text, '{st.LETTERS}', '{st.LETTERS.upper()}'), '[*#+]+$', ''), '[^{seqf.AMINO_ACIDS}]', 'X', 'g') AS s FROM documents WHERE text <> '')
    SELECT doc_id, i - 1 AS pos, round((length(s) - length(replace(s, c[i], ''))) / greatest(length(s), 1), 6) AS value FROM s, (SELECT ['{_LETTERS}'] AS c), range(1, {len(seqf.AMINO_ACIDS) + 1}) t(i)"""
)
def protein_embed(spark, d):
    """Proteins through the batch hook: here the share of each amino acid."""
    rows = table(spark, d, "documents").filter("text <> ''").select("doc_id", seqf.clean_protein(F.translate("text", st.LETTERS, st.LETTERS.upper())).alias("text"))
    return _spread(embed.embed_batches(rows, embed.base_frequencies(1, seqf.AMINO_ACIDS), ["doc_id"], batch=4), "doc_id")


@query("SELECT regexp_replace(source || '.v1.' || lang || '.fa', '[.][^.]*$', '') AS stem, count(*) AS n FROM documents GROUP BY 1")
def file_stems(spark, d):
    """Names without their last suffix."""
    name = F.concat_ws(".", "source", F.lit("v1"), "lang", F.lit("fa"))
    return table(spark, d, "documents").groupBy(fasta.stem(name).alias("stem")).agg(F.count("*").alias("n"))


@query("SELECT s AS status, count(doc_id) AS n FROM (SELECT unnest(['ok', 'skip', 'error', 'empty', 'no_output']) AS s) LEFT JOIN (SELECT doc_id, CASE WHEN length(text) < 100 THEN 'empty' WHEN lang = 'en' THEN 'ok' WHEN lang = 'de' THEN 'skip' ELSE 'error' END AS t FROM documents) ON t = s GROUP BY 1")
def status_summary(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.length("text") < 100, "empty").when(F.col("lang") == "en", "ok").when(F.col("lang") == "de", "skip").otherwise("odd").alias("status"))
    return embed.status_summary(rows)


@query("SELECT doc_id, n_chars FROM documents WHERE NOT (doc_id % 3 = 0 AND n_chars % 2 = 0)")
def skip_processed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    done = docs.filter("doc_id % 3 = 0").withColumn("text", F.when(F.col("n_chars") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" changed"))))
    done = done.select("doc_id", embed.content_key("text").alias("content_key"))
    return embed.unprocessed(docs, done, "doc_id", "text").select("doc_id", "n_chars")


@query(f"SELECT 'doc' || doc_id AS seq_id, length({st.DNA_SQL}) AS n FROM documents")
def incremental_ingest(spark, d):
    """Half of the records arrive, then the rest; a last run finds nothing new."""
    folder, out, marks = (shared_folder(spark, n) for n in ("arrivals", "ingested", "marks"))
    records = st.sequences(spark, d).select(F.concat(F.lit("doc"), F.col("seq_id").cast("string")).alias("seq_id"), "seq", (F.col("seq_id") % 2).alias("half"))
    handle = lambda batch: batch.select("seq_id", F.length("seq").cast("long").alias("n"))
    for half in (0, 1):
        lines = records.filter(F.col("half") == half).select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq").alias("value"))
        lines.write.mode("append").text(folder)
        incremental.ingest(incremental.new_records(spark, folder), handle, out, marks)
    incremental.ingest(incremental.new_records(spark, folder), handle, out, marks)
    return spark.read.parquet(out).select("seq_id", "n")


# Tables and files that are written and read again


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(embedding), 4) AS total FROM embeddings WHERE vec_id % 7 <> 0")
def embedding_store(spark, d):
    """Vectors added in two steps, some of them null, and read without those."""
    path = shared_folder(spark, "embeddings")
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    for part in (0, 1):
        sinks.append_embeddings(rows.filter(F.col("vec_id") % 2 == part), path)
    return fasta.read_embeddings(spark, path).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(vec.total(F.col("embedding").cast("array<double>")), 4).alias("total"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_owners(spark, d):
    return fasta.missing_owners(table(spark, d, "documents"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("SELECT label AS owner_id, vec_id AS protein_id, round(list_sum(embedding), 4) AS total FROM embeddings")
def protein_store(spark, d):
    """Vectors in folders by owner, of the width that the table has."""
    path = shared_folder(spark, "proteins")
    sinks.write_protein_embeddings(table(spark, d, "embeddings").select(F.col("label").alias("owner_id"), F.col("vec_id").alias("protein_id"), "embedding"), path)
    again = tables.checked_width(spark.read.parquet(path), st.feature_width(spark, d))
    return again.select("owner_id", "protein_id", F.round(vec.total(F.col("embedding").cast("array<double>")), 4).alias("total"))


@query(f"{_SKETCH} SELECT id, hash, abund FROM sk")
def sketch_store(spark, d):
    path = shared_folder(spark, "sketches")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    sinks.write_sketches(_sketches(spark, d), name, path)
    return tables.read_sketches(spark, name)


@query("SELECT 'label' || label AS name, i AS row, round(avg(embedding[i]), 6) AS value FROM embeddings, range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) t(i) GROUP BY label, i")
def params_store(spark, d):
    """Parameters by name, here one vector a label, written under model_state and read with exactly these names."""
    path = shared_folder(spark, "params")
    means = embed_means(table(spark, d, "embeddings"))
    means.select(F.concat(F.lit("model_state.label"), F.col("label").cast("string")).alias("name"), F.array(F.size("v")).alias("shape"), F.col("v").alias("data")).write.parquet(path)
    wanted = table(spark, d, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("name")).distinct()
    rows = tables.params_table(spark, path, wanted).select("name", F.posexplode("data").alias("pos", "value"))
    return rows.select("name", (F.col("pos") + 1).cast("long").alias("row"), F.round("value", 6).alias("value"))


def embed_means(rows):
    return rows.groupBy("label").agg(vec.mean_vector(F.col("embedding")).alias("v"))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def missing_names(spark, d):
    """Names that are required and not there: nations without a supplier in debt."""
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    present = table(spark, d, "supplier").filter("s_acctbal < 0").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return tables.missing_names(nations, present)


@query("SELECT n_nationkey AS taxid, n_name || ' (' || n_regionkey || ')' AS species FROM nation")
def species_tsv(spark, d):
    """A tab-separated dimension in which a later row of a taxid counts."""
    path = shared_folder(spark, "species")
    nations = table(spark, d, "nation")
    first = nations.select("n_nationkey", F.lit(0).alias("turn"), F.col("n_name").alias("species"))
    last = nations.select("n_nationkey", F.lit(1).alias("turn"), F.concat("n_name", F.lit(" ("), F.col("n_regionkey").cast("string"), F.lit(")")).alias("species"))
    sinks.write_tsv(first.unionByName(last).coalesce(1).sortWithinPartitions("turn").select(F.col("n_nationkey").alias("taxid"), "species"), path)
    return fasta.read_species(spark, path)


@query("SELECT 'nation' AS ntype, n_name AS id, n_nationkey::BIGINT AS idx FROM nation UNION ALL SELECT 'region', r_name, r_regionkey FROM region")
def node_maps(spark, d):
    """A JSON file of maps id -> index by node type, of the two small dimensions."""
    path = shared_folder(spark, "maps")
    of = lambda name, key, value: table(spark, d, name).select(F.lit(f"{name}_map").alias("ntype"), F.col(value).alias("id"), F.col(key).cast("long").alias("idx"))
    rows = of("nation", "n_nationkey", "n_name").unionByName(of("region", "r_regionkey", "r_name"))
    maps = rows.groupBy("ntype").agg(F.map_from_entries(F.collect_list(F.struct("id", "idx"))).alias("ids"))
    maps.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("ntype", "ids")))).alias("value")).coalesce(1).write.text(path)
    return fasta.read_node_maps(spark, path)


@query("SELECT 'doc' || min(doc_id) AS seq_id FROM documents GROUP BY lang")
def first_records(spark, d):
    """The first record of each language's files; a language is a folder of parts in order."""
    path = shared_folder(spark, "by-language")
    rows = table(spark, d, "documents").select("lang", "doc_id", "text")
    value = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit("\n"), st.dna(F.col("text")))
    fasta.write_parts(rows, "lang", "doc_id", value, path, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return fasta.first_of_parts(fasta.read_fasta(spark, path, (".txt",))).select("seq_id")


@query("WITH r AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS file, row_number() OVER (ORDER BY lang, doc_id) - 1 AS n FROM documents) SELECT 'doc' || doc_id AS seq_id, n AS nth_record FROM r")
def record_order(spark, d):
    """Records of all files, numbered in the order of paths."""
    path = shared_folder(spark, "ordered")
    rows = table(spark, d, "documents").select("lang", "doc_id")
    value = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit("\nAC"))
    fasta.write_parts(rows, "lang", "doc_id", value, path, 32 * rows.count())
    return fasta.positions(fasta.read_fasta(spark, path, (".txt",))).select("seq_id", "nth_record")


@query(f"SELECT sum(strlen('>doc' || doc_id || chr(10) || {st.DNA_SQL} || chr(10)))::BIGINT AS bytes FROM documents")
def file_listing(spark, d):
    """The bytes of the files of one suffix below a folder."""
    path = shared_folder(spark, "listing")
    fasta.write_fasta(st.sequences(spark, d).select(F.concat(F.lit("doc"), F.col("seq_id").cast("string")).alias("seq_id"), "seq"), path)
    return tables.files(spark, path, ".TXT").agg(F.sum("length").alias("bytes"))


@query(
    """SELECT o_custkey AS query_id, count(DISTINCT o_orderkey) AS n_proteins, count(*) AS n_edges, count(DISTINCT l_suppkey) AS n_sources, round(sum(l_quantity), 4) AS total
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def summary_json(spark, d):
    """One JSON object a query with its counts and similarity edges, read again."""
    path = shared_folder(spark, "summary")
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(F.col("o_custkey").alias("query_id"), F.col("l_suppkey").alias("src_id"), F.col("o_custkey").alias("dst_id"), F.col("l_quantity").alias("weight"))
    sinks.write_summary(lines.groupBy(F.col("o_custkey").alias("query_id")).agg(F.count_distinct("o_orderkey").alias("n_proteins")), edges, path)
    again = spark.read.schema("query_id long, n_proteins long, similarity_edges array<struct<src_id: long, dst_id: long, weight: double>>").json(path)
    e = F.col("similarity_edges")
    return again.select("query_id", "n_proteins", F.size(e).cast("long").alias("n_edges"), F.size(F.array_distinct(e.src_id)).cast("long").alias("n_sources"), F.round(vec.total(e.weight), 4).alias("total"))


# More of vectors and records


_EIGHTS = "e AS (SELECT vec_id // 8 AS seq_id, vec_id % 8 AS place, (vec_id % 3 <> 0)::INT AS mask, embedding FROM embeddings)"


def _eights(spark, d):
    """Vectors of a sequence's tokens: eight in a row."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("seq_id"), F.struct((F.col("vec_id") % 8).alias("at"), F.when(F.col("vec_id") % 3 != 0, 1.0).otherwise(0.0).alias("mask"), "embedding").alias("t"))
    return rows.groupBy("seq_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


@query(f"WITH {_EIGHTS} SELECT seq_id, p - 1 AS pos, round(sum(mask * embedding[p]::DOUBLE) / greatest(sum(mask), 1e-9), 6) AS value FROM e, range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) t(p) GROUP BY seq_id, p")
def masked_mean(spark, d):
    return _spread(_eights(spark, d).select("seq_id", vec.masked_mean(F.col("t.embedding"), F.col("t.mask")).alias("embedding")), "seq_id")


@query(f"WITH {_EIGHTS}, n AS (SELECT seq_id, count(*) - 2 AS n FROM e GROUP BY 1 HAVING n > 0) SELECT seq_id, p - 1 AS pos, round(avg(embedding[p]::DOUBLE), 6) AS value FROM e JOIN n USING (seq_id), range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) t(p) WHERE place >= 1 AND place <= n GROUP BY seq_id, p")
def residue_mean(spark, d):
    """The mean without the first and the last vector."""
    rows = _eights(spark, d).select("seq_id", vec.residue_mean(F.col("t.embedding"), F.size("t") - 2).alias("embedding"))
    return _spread(rows.filter("embedding is not null"), "seq_id")


@query(f"SELECT vec_id, i AS pos, round(list_sum(list_transform(range(len(embedding)), lambda j: {st.weight_sql('i', 'j', 1)} * embedding[j + 1]::DOUBLE)) + {st.weight_sql('0', 'i', 2)}, 6) AS value FROM embeddings, range(3) t(i)")
def linear_map(spark, d):
    width = st.feature_width(spark, d)
    out = vec.linear(F.col("embedding"), st.weights(3, width, 1).tolist(), st.weights(1, 3, 2)[0].tolist())
    return _spread(table(spark, d, "embeddings").select("vec_id", out.alias("embedding")), "vec_id")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS t FROM orders)
    SELECT 's' || o_custkey AS original_id, 's' || o_custkey || CASE WHEN t = 0 THEN '' ELSE '_' || t END AS id, o_orderkey AS position, o_totalprice FROM r"""
)
def renamed_records(spark, d):
    """Records under the ids that they were given, with their other columns and the ids that they had."""
    records = table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("position"), "o_totalprice")
    assigned = graph.unique_ids(records, records.limit(0).select("id"))
    return graph.renamed(records, assigned).select("original_id", "id", "position", "o_totalprice")


@query(f"WITH v AS ({_VALUES}), m AS (SELECT label, pos, avg(v) AS v FROM v GROUP BY 1, 2) SELECT 'file' || label AS source_file, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m")
def file_vectors(spark, d):
    """One vector a file: the mean over its records."""
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("file"), F.col("label").cast("string")).alias("source_file"), "embedding")
    return _spread(embed.group_vectors(rows, "source_file"), "source_file")
