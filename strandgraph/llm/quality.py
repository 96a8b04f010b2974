"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: the ledger holds the measurements and one long with a bit for
each rule that failed. Policies are versioned sets of rules; applying one, or asking what a rule alone changes,
needs bit operations on the ledger only, never the texts again. All of it is built-in SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.store import id_of, key_of

#: Words `[^\x20\x09-\x0D]+` are what stands between these.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL over the ledger's measurements, true where a document fails.
    fails: str


#: A rule's place is its bit and never changes; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "10 * word_chars < 25 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("capitals", "100 * n_upper > 50 * word_chars"),
    Rule("few_letters", "100 * n_letters < 60 * word_chars"),
    Rule("exclamations", "100 * n_exclaims > 30 * n_words"),
    Rule("many_words", "n_words > 1000000"),
)
#: The rules that decide, by version of the policy.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "capitals", "few_letters", "exclamations"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_exclaims")


def policy_mask(version: int) -> int:
    """The bits of a policy's rules."""
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[version])


def _count(pattern: str) -> Column:
    """Characters of text that match a class."""
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def _repeat_words() -> list[tuple[str, Column]]:
    """Steps to n_repeat_words: windows as (hash, place) in order of hash, then the places whose neighbour has
    the same hash, then the words that these windows cover."""
    windows = F.expr("if(size(words) < 3, cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(sequence(0, greatest(size(words) - 3, 0)), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) as h, i as i))))")
    twice = F.expr("sort_array(filter(transform(windows, (x, j) -> if((j > 0 and windows[greatest(j - 1, 0)].h = x.h) or (j + 1 < size(windows) and windows[least(j + 1, size(windows) - 1)].h = x.h), x.i, -1)), i -> i >= 0))")
    words = F.expr("aggregate(twice, struct(-3 as last, 0L as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n)")
    return [("windows", windows), ("twice", twice), ("n_repeat_words", words)]


def _measured(docs: DataFrame, keep: str) -> DataFrame:
    """The column `keep` of docs(keep, text) with MEASURES and failures."""
    out = docs.select(keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    for name, column in _repeat_words():
        out = out.withColumn(name, column)
    out = out.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    # What stands between letters is taken out run by run: fewer matches than letters.
    out = out.withColumn("letters", F.regexp_replace("text", r"[^\p{L}]+", ""))
    out = out.select(
        keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        (F.length("letters") - F.length(F.regexp_replace("letters", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.length("letters").cast("long").alias("n_letters"),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
    )
    bits = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("failures", bits)


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """k (the id as a key, see store.key_of), the MEASURES and failures, a long with bit i set where RULES[i] fails.

    One row for each row of docs, repeated rows included. A null text counts as empty: it has no words and fails
    few_words. A null id stays a row. An empty table gives no rows. Other columns aren't read.
    """
    return _measured(docs.select(key_of(id_column).alias("k"), F.col(text_column).alias("text")), "k")


def passes(version: int) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """What each rule of a policy does, in one aggregate over the ledger: rule, n_failed, n_only (documents that
    fail it alone, so that the policy without it would keep them), n_kept (by the policy without it)."""
    mask = policy_mask(version)
    here = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    aggs = []
    names = [(i, r.name) for i, r in enumerate(RULES) if r.name in POLICIES[version]]
    for i, name in names:
        bit = F.lit(1 << i).cast("long")
        aggs += [
            F.count_if(here.bitwiseAND(bit) != 0).alias(f"{name}__failed"),
            F.count_if(here == bit).alias(f"{name}__only"),
            F.count_if(here.bitwiseAND(F.lit(mask & ~(1 << i)).cast("long")) == 0).alias(f"{name}__kept"),
        ]
    one = rows.agg(*aggs)
    each = F.array(*(F.struct(F.lit(n).alias("rule"), *(F.col(f"{n}__{x}").alias(f"n_{x}") for x in ("failed", "only", "kept"))) for _, n in names))
    return one.select(F.inline(each))


def keep_good(docs: DataFrame, version: int = 2) -> DataFrame:
    """The rows of docs that pass a policy, with all their columns, whatever their names. No row is shuffled."""
    rows = _measured(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), "row")
    # A filter would be pushed below the steps of _measured, and each step's expression be put into the next one's
    # lambda, where it runs for each element; it can't pass a generator.
    rows = rows.select("row", F.explode(F.array("failures")).alias("failures"))
    return rows.filter(passes(version)).select("row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 2, with the newest policy as verdict."""
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = policy_mask(1)
    failed = F.col("failures").bitwiseAND(F.lit(base).cast("long")) != 0
    return rows.select(id_of("k").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes(max(POLICIES))).alias("kept"), "failures")
