"""Stand-ins for sequences, nodes and edges, made from the general tables, with the same in DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.sequence import replaced_letters

LETTERS = "abcdefghijklmnopqrstuvwxyz"
TO_DNA = ("ACGT" * 7)[:26]
TO_RNA = ("acgu" * 7)[:26]
#: Heads and numbers of a head in single layers; numbers of a node's state in the whole model.
HEADS, DIM, HIDDEN = 2, 4, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, TO_DNA), "[^ACGT]", "")


def rna(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, TO_RNA), "[^acgu \n]", "")


DNA_SQL = f"regexp_replace(translate(lower(text), '{LETTERS}', '{TO_DNA}'), '[^ACGT]', '', 'g')"
RNA_SQL = f"regexp_replace(translate(lower(text), '{LETTERS}', '{TO_RNA}'), '[^acgu ' || chr(10) || ']', '', 'g')"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, seq: dna() of each document's text, letter by letter in Arrow batches."""
    lower = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.lower("text").alias("seq"))
    return replaced_letters(lower, "seq_id", "seq", dict(zip(LETTERS, TO_DNA)))


def features(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """idx, x: the vector of number idx % (number of vectors)."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return keys.withColumn("vec_id", F.pmod("idx", F.lit(n))).join(x, "vec_id").select("idx", "x")


def feature_width(spark: SparkSession, sf_dir: str) -> int:
    """Numbers in a vector of the table; 1 without any."""
    first = table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("n")).first()
    return first.n if first else 1


def weights(rows: int, columns: int, shift: int = 0) -> np.ndarray:
    """A closed form that SQL can make as well."""
    i, j = np.indices((rows, columns))
    return ((7 * (i + shift) + 3 * j) % 11 - 5) / 10


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src customer, dst part)."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = orders.select("o_orderkey", F.col("o_custkey").alias("src")).join(items.select("l_orderkey", F.col("l_partkey").alias("dst")), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("src", "dst").distinct()


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src supplier, dst part)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


FEATURES_SQL = """
vecs AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
cust AS (SELECT c_custkey AS idx, x FROM customer JOIN vecs ON vec_id = c_custkey % n),
supp AS (SELECT s_suppkey AS idx, x FROM supplier JOIN vecs ON vec_id = s_suppkey % n),
prt AS (SELECT p_partkey AS idx, x FROM part JOIN vecs ON vec_id = p_partkey % n),
buys AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
supplies AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"""


def weight_sql(i: str, j: str, shift: int) -> str:
    return f"(((7 * ({i} + {shift}) + 3 * {j}) % 11 - 5) / 10.0)"


def linear_sql(x: str, rows: int, shift: int, bias: int | None = None) -> str:
    """weights(rows, width of x, shift) @ x, and the first row of weights(1, rows, bias)."""
    more = f" + {weight_sql('0', 'i', bias)}" if bias is not None else ""
    return f"list_transform(range({rows}), lambda i: list_sum(list_transform(range(len({x})), lambda j: {weight_sql('i', 'j', shift)} * {x}[j + 1])){more})"


def attended_sql(name: str, edges: str, src: str, dst: str, shift: int, dim: int = DIM) -> str:
    """CTEs that end in name(idx, pos, v): see operators.attention.attended with weights of this shift."""
    n, part = HEADS * dim, lambda c: f"{c}[head * {dim} + 1 : head * {dim} + {dim}]"
    return f"""
{name}_s AS (SELECT idx, {linear_sql("x", n, shift)} AS h FROM {src}), {name}_d AS (SELECT idx, {linear_sql("x", n, shift + 1)} AS h FROM {dst}),
{name}_e AS (SELECT e.dst, s.h AS hl, d.h AS hr FROM {edges} e JOIN {name}_s s ON s.idx = e.src JOIN {name}_d d ON d.idx = e.dst),
{name}_h AS (SELECT dst, head, {part("hl")} AS msg, {part("hr")} AS own FROM {name}_e, range({HEADS}) t(head)),
{name}_l AS (SELECT dst, head, msg, list_sum(list_transform(range({dim}), lambda i: {weight_sql("head", "i", shift + 2)} * (CASE WHEN msg[i + 1] + own[i + 1] > 0 THEN 1.0 ELSE 0.2 END) * (msg[i + 1] + own[i + 1]))) AS logit FROM {name}_h),
{name}_w AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY dst, head)) AS w FROM {name}_l),
{name}_p AS (SELECT dst, pos, sum(v) / {HEADS} AS v FROM (SELECT dst, head, pos, sum(w * msg[pos + 1]) / sum(w) AS v FROM {name}_w, range({dim}) t(pos) GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT d.idx, t.pos, coalesce(p.v, 0) + {weight_sql("0", "t.pos", shift + 3)} AS v FROM {dst} d CROSS JOIN range({dim}) t(pos) LEFT JOIN {name}_p p ON p.dst = d.idx AND p.pos = t.pos)"""


def gated_sql(name: str, outs: list[str], dim: int) -> str:
    """CTEs that end in name(idx, pos, v): see operators.attention.gated with the weights of queries.GATE, over outs of attended_sql."""
    logit = f"""list_sum(list_transform(range(3), lambda i: {weight_sql("0", "i", 9)} * tanh(list_sum(list_transform(range({dim}), lambda j: {weight_sql("i", "j", 8)} * vs[j + 1])) + {weight_sql("0", "i", 4)})))"""
    rows = " UNION ALL ".join(f"SELECT '{o}' AS r, idx, list(v ORDER BY pos) AS vs FROM {o} GROUP BY ALL" for o in outs)
    return f"""
{name}_o AS ({rows}), {name}_g AS (SELECT *, exp({logit}) AS w FROM {name}_o),
{name} AS (SELECT idx, pos, sum(w * vs[pos + 1]) / sum(w) AS v FROM {name}_g, range({dim}) t(pos) GROUP BY idx, pos)"""


#: Relations of the whole model: source, edges (reversed where marked), destination.
RELATIONS = (("cust", "buys", "prt"), ("prt", "bought_by", "cust"), ("supp", "supplies", "prt"), ("prt", "supplied_by", "supp"))


def model_sql(layers: int = 2) -> str:
    """WITH clauses that end in cust_z, prt_z and supp_z(idx, x): see queries.model."""
    ctes = [FEATURES_SQL, "bought_by AS (SELECT dst AS src, src AS dst FROM buys), supplied_by AS (SELECT dst AS src, src AS dst FROM supplies)"]
    kinds = ("cust", "prt", "supp")
    for i, kind in enumerate(kinds):
        ctes.append(f"{kind}_0 AS (SELECT idx, list_transform({linear_sql('x', HIDDEN, i, i)}, lambda v: greatest(v, 0)) AS x FROM {kind})")
    for n in range(layers):
        into: dict[str, list[str]] = {k: [] for k in kinds}
        for shift, (src, rel, dst) in enumerate(RELATIONS):
            ctes.append(attended_sql(f"{rel}_{n}", rel, f"{src}_{n}", f"{dst}_{n}", shift, HIDDEN))
            into[dst].append(f"{rel}_{n}")
        for kind, outs in into.items():
            ctes.append(gated_sql(f"{kind}_a{n}", outs, HIDDEN))
            ctes.append(f"""
{kind}_y{n} AS (SELECT s.idx, a.pos, s.x[a.pos + 1] + a.v AS v FROM {kind}_{n} s JOIN {kind}_a{n} a ON a.idx = s.idx),
{kind}_{n + 1} AS (SELECT idx, list(greatest((v - m) / sqrt(q + 1e-5), 0) ORDER BY pos) AS x FROM (SELECT *, avg(v) OVER (PARTITION BY idx) AS m, var_pop(v) OVER (PARTITION BY idx) AS q FROM {kind}_y{n}) GROUP BY idx)""")
    for kind in kinds:
        ctes.append(f"{kind}_f AS (SELECT idx, {linear_sql('x', HIDDEN, 6, 7)} AS x FROM {kind}_{layers})")
        ctes.append(f"{kind}_z AS (SELECT idx, list_transform(x, lambda v: v / (CASE WHEN list_dot_product(x, x) > 0 THEN sqrt(list_dot_product(x, x)) ELSE 1 END)) AS x FROM {kind}_f)")
    return "WITH " + ", ".join(ctes)


def updated_sql(name: str, before: str, aggregate: str) -> str:
    """CTEs that end in name(idx, x): see operators.attention.updated, over before(idx, x) and aggregate(idx, pos, v)."""
    return f"""
{name}_y AS (SELECT s.idx, a.pos, s.x[a.pos + 1] + a.v AS v FROM {before} s JOIN {aggregate} a ON a.idx = s.idx),
{name} AS (SELECT idx, list(greatest((v - m) / sqrt(q + 1e-5), 0) ORDER BY pos) AS x FROM (SELECT *, avg(v) OVER (PARTITION BY idx) AS m, var_pop(v) OVER (PARTITION BY idx) AS q FROM {name}_y) GROUP BY idx)"""


def isolated_sql() -> str:
    """WITH clauses that end in cust_z(idx, x): each customer by itself on the graph of parts and suppliers, see
    queries.isolated_embed. ov has a row for each part as one customer sees it."""
    ctes = [FEATURES_SQL, "bought_by AS (SELECT dst AS src, src AS dst FROM buys)"]
    for i, kind in enumerate(("cust", "prt", "supp")):
        ctes.append(f"{kind}_0 AS (SELECT idx, list_transform({linear_sql('x', HIDDEN, i, i)}, lambda v: greatest(v, 0)) AS x FROM {kind})")
    # Without purchases a customer is in no relation, so not even its bias counts.
    heard = lambda out, name: f"{name} AS (SELECT idx, pos, CASE WHEN idx IN (SELECT src FROM buys) THEN v ELSE 0 END AS v FROM {out})"
    ctes += [attended_sql("bb0", "bought_by", "prt_0", "cust_0", 1, HIDDEN), heard("bb0", "hb0"), updated_sql("cust_1", "cust_0", "hb0"), attended_sql("sp0", "supplies", "supp_0", "prt_0", 2, HIDDEN)]
    ctes.append("ov0 AS (SELECT src * 1000000007 + dst AS idx, src AS q, dst AS p, x FROM buys JOIN prt_0 ON prt_0.idx = dst), there AS (SELECT q AS src, idx AS dst FROM ov0), back AS (SELECT idx AS src, q AS dst FROM ov0)")
    ctes += [attended_sql("b0", "there", "cust_0", "ov0", 0, HIDDEN), "s0 AS (SELECT ov0.idx, pos, v FROM ov0 JOIN sp0 ON sp0.idx = p)", gated_sql("g0", ["b0", "s0"], HIDDEN), updated_sql("ov1", "ov0", "g0")]
    ctes += [attended_sql("bb1", "back", "ov1", "cust_1", 1, HIDDEN), heard("bb1", "hb1"), updated_sql("cust_2", "cust_1", "hb1")]
    ctes.append(f"cust_f AS (SELECT idx, {linear_sql('x', HIDDEN, 6, 7)} AS x FROM cust_2)")
    ctes.append("cust_z AS (SELECT idx, list_transform(x, lambda v: v / (CASE WHEN list_dot_product(x, x) > 0 THEN sqrt(list_dot_product(x, x)) ELSE 1 END)) AS x FROM cust_f)")
    return "WITH " + ", ".join(ctes)
