"""The training-data pipeline: each stage takes what the one before kept.

Stages take and return the columns of documents; the last returns tokens. Near copies are documents whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.bpe import decoded, encoded
from strandgraph.llm.jaccard import similar_components
from strandgraph.llm.leaks import without_leaks
from strandgraph.llm.quality import keep_good
from strandgraph.llm.store import discard, id_of, identified, written
from strandgraph.llm.substrings import strip_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest quality policy."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest identity (id, then text; see store.identified) of each component of near copies; documents
    without words have no copies. Rows that repeat it in all, id and text, are one."""
    names = ("kept_key_of_row", "kept_half_of_row", "kept_other_half_of_row")
    found = similar_components(docs, size=5, num=80, den=100)
    kept = found.filter("first").select("k", "v1", "v2").toDF(*names).distinct()
    rows, _ = identified(docs, names=names)
    return rows.join(kept, list(names)).dropDuplicates([*names, "text"]).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier in the corpus."""
    return strip_repeats(docs, window=20)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the digest of the text that they decode to."""
    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = decoded(encoded(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return both.select(id_of("k").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Components of near copies and BPE are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
