"""Embedding of sequences and proteins through batch hooks that the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.sequence import reverse_complement, small_batches
from strandgraph.functions.sequence import windows as cut_windows
from strandgraph.functions.vectors import l2_normalize, mean_vector

Hook = Callable[[], Callable[[list[str]], np.ndarray]]

# What statuses there are.
STATUSES = ("ok", "skip", "error", "empty", "no_output")


def windows(sequences: DataFrame, k: int, width: int, stride: int, most: int | None = None, both_strands: bool = False) -> DataFrame:
    """seq_id, strand, win_idx, text: windows of `width` k-mers, at most `most` of them, evenly spread.

    Starts are chosen before any text is cut. A sequence of fewer letters than k is one window.
    """
    small_batches(sequences)
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s")), *([F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("s"))] if both_strands else []))
    each = sequences.filter(F.col("seq").isNotNull()).select("seq_id", F.explode(strands).alias("x")).select("seq_id", "x.strand", "x.s")
    return cut_windows(each, k, width, stride, most, ("seq_id", "strand")).drop("start")


def kmer_text(text: Column, k: int) -> Column:
    """A window's k-mers joined by blanks; a window shorter than k is its only one."""

    @F.pandas_udf("string")
    def joined(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None or len(t) <= k:
                out.append(t)
            elif t.isascii():
                rows = np.full((len(t) - k + 1, k + 1), 32, np.uint8)
                rows[:, :k] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(t.encode(), np.uint8), k)
                out.append(rows.tobytes()[:-1].decode())
            else:
                out.append(" ".join(t[i : i + k] for i in range(len(t) - k + 1)))
        return pd.Series(out, dtype=object)

    return joined(text)


def base_frequencies(k: int = 2, letters: str = "ACGT") -> Hook:
    """The default hook: the share of each k-mer over the letters."""

    def make():
        code = np.full(256, -1, np.int64)
        code[list(letters.encode())] = np.arange(len(letters))

        def embed(texts: list[str]) -> np.ndarray:
            # A byte that is no letter, here for text ends as well, spoils the k-mers that it is in.
            data = code[np.frombuffer("\0".join(texts).encode("latin-1", "replace"), np.uint8)]
            row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(data)]
            n = max(0, len(data) - k + 1)
            at, good = np.zeros(n, np.int64), np.ones(n, bool)
            for j in range(k):
                part = data[j : j + n]
                at, good = at * len(letters) + part, good & (part >= 0)
            size = len(letters) ** k
            out = np.bincount(row[:n][good] * size + at[good], minlength=len(texts) * size).reshape(len(texts), size).astype(float)
            return out / np.maximum(out.sum(1, keepdims=True), 1)

        return embed

    return make


def layer_number(layers: int, wanted: int | None) -> int:
    """The layer of a protein model that vectors are taken from: without a wish, or beyond the last, the last but one."""
    return layers - 1 if wanted is None or wanted >= layers else wanted


def embed_batches(rows: DataFrame, hook: Hook, keys: list[str], batch: int = 8, text: str = "text") -> DataFrame:
    """keys, embedding, status, error: each text's vector. A batch that fails is tried text by text, and a text that fails is
    a row with status error: nothing is lost silently. The hook's model is made once a task."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", embedding array<double>, status string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = hook()
        for frame in frames:
            vectors, errors = [], []
            for a in range(0, len(frame), batch):
                part = frame[text].iloc[a : a + batch].tolist()
                try:
                    got, said = list(np.asarray(embed(part), dtype=float)), [None] * len(part)
                except Exception:
                    got, said = [], []
                    for t in part:
                        try:
                            got.append(np.asarray(embed([t])[0], dtype=float))
                            said.append(None)
                        except Exception as e:
                            got.append(None)
                            said.append(f"{type(e).__name__}: {e}"[:500])
                vectors += got
                errors += said
            out = frame[keys].copy()
            out["embedding"], out["error"] = vectors, errors
            out["status"] = ["ok" if e is None else "error" for e in errors]
            yield out[[*keys, "embedding", "status", "error"]]

    return rows.select(*keys, text).mapInPandas(run, schema)


def sequence_vectors(window_vectors: DataFrame) -> DataFrame:
    """seq_id, embedding: the mean of a strand's windows, then of the strands, of length 1."""
    by_strand = window_vectors.filter(F.col("embedding").isNotNull()).groupBy("seq_id", "strand").agg(mean_vector(F.col("embedding")).alias("v"))
    return by_strand.groupBy("seq_id").agg(mean_vector(F.col("v")).alias("v")).select("seq_id", l2_normalize(F.col("v")).alias("embedding"))


def group_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, embedding: the mean of its rows' vectors, of length 1; null vectors don't count."""
    return rows.filter(F.col(vector).isNotNull()).groupBy(key).agg(mean_vector(F.col(vector)).alias("v")).select(key, l2_normalize(F.col("v")).alias("embedding"))


def status_summary(rows: DataFrame) -> DataFrame:
    """status, n for each of STATUSES, zero where none; other statuses count as error."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("error")
    domain = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return domain.join(rows.groupBy(known.alias("status")).agg(F.count("*").alias("n")), "status", "left").fillna({"n": 0})


def content_key(*columns: str) -> Column:
    """The digest of the columns' values as JSON, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def unprocessed(rows: DataFrame, done: DataFrame, key: str, *content: str) -> DataFrame:
    """Rows whose key and content aren't done yet; done has key and content_key."""
    keyed = rows.withColumn("content_key", content_key(*content))
    return keyed.join(done.select(key, "content_key"), [key, "content_key"], "left_anti")
