"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

The trees are trained on URLs that a rule labels. Features, training table and scores are DataFrame
expressions and Spark's own tree learner; no Python runs on executors. Statistics of host suffixes and of first path
segments cover all pages; a training URL gets rates of the other folds only, so that no URL's own label is among its features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.store import discard, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract: each fits its host and all subdomains where the path starts so.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Labelled URLs that the trees are trained on at most; distinct ones of smallest hash, so any run takes the same.
TRAINING_ROWS = 20_000
#: Statistics are broadcast up to so many keys and shuffled beyond.
BROADCAST_KEYS = 100_000
#: URLs are dealt to so many folds by hash.
FOLDS = 5
#: Labelled pages that a rate is drawn to the rate of all by.
DRAWN = 5
#: What statistics are kept of: the host's last two labels, and the path up to its second slash.
KEYS = ("suffix", "segment")
TREES, DEPTH = 20, 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "path_digits", "hyphens", "entropy", "parameters", "query_length", "fragment", "secure", "segments", "segment_length", "suffix_rate", "suffix_count", "segment_rate", "segment_count")


def located(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path: see the contract. A null url, or one without ://, has both empty."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1))


def rule_column(rules: tuple[Rule, ...], of) -> Column:
    """of(rule) for the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(of(r))).otherwise(out)
    return out


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _entropy(s: Column) -> Column:
    """Bits per character, by each character's share."""
    n = F.length(s)
    share = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def _keys() -> dict[str, Column]:
    return {"suffix": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0), "segment": F.regexp_extract("path", "(?s)^/?[^/]*/?", 0)}


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """located(pages) with KEYS, fold, and the features that need no statistics."""
    out = located(pages, url)
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    gone = lambda c, p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    columns = {
        "url_length": F.length(text),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": gone(F.col("path"), "/"),
        "labels": gone(F.col("host"), r"\."),
        "digit_ratio": _ratio(gone(text, "[0-9]"), F.length(text)),
        "path_digits": gone(F.col("path"), "[0-9]"),
        "hyphens": gone(F.col("host"), "-"),
        "entropy": _entropy(F.col("host")),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "fragment": F.when(text.contains("#"), 1).otherwise(0),
        "secure": F.when(text.startswith("https:"), 1).otherwise(0),
        "segments": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "segment_length": F.length(_keys()["segment"]),
    }
    return out.withColumns({**_keys(), "fold": _fold(text), **{k: v.cast("double") for k, v in columns.items()}})


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def statistics(pages: DataFrame, rules: tuple[Rule, ...], url: str) -> tuple[dict[str, DataFrame], float]:
    """For each of KEYS a table (key, fold, its count and rate), and the share of blocked ones of all labelled pages. Counts are
    over all pages. Rates are the share of blocked ones of the labelled pages, drawn to that of all: with fold null of all
    folds, else of the folds but that one."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    seen = located(pages.select(url), url).select(*(v.alias(k) for k, v in _keys().items()), _fold(text).alias("fold"), rule_column(rules, lambda r: r.verdict).alias("verdict"))
    sums = [F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked")]
    each = {k: written(seen.groupBy(k, "fold").agg(*sums), "statistics") for k in KEYS}
    labelled, blocked = each[KEYS[0]].agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = blocked / labelled if labelled else 0.0
    tables = {}
    for k, counts in each.items():
        whole = counts.groupBy(k).agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        others = counts.join(whole.toDF(k, "all_n", "all_labelled", "all_blocked"), k).select(k, "fold", F.col("all_n").alias("n"), (F.col("all_labelled") - F.col("labelled")).alias("labelled"), (F.col("all_blocked") - F.col("blocked")).alias("blocked"))
        rate = (F.col("blocked") + DRAWN * F.lit(prior)) / (F.col("labelled") + DRAWN)
        rows = whole.withColumn("fold", F.lit(None).cast("int")).unionByName(others)
        tables[k] = written(rows.select(k, "fold", F.col("n").cast("double").alias(f"{k}_count"), rate.alias(f"{k}_rate")), f"{k}-rates")
    discard(*each.values())
    return tables, prior


def train(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", rows: int = TRAINING_ROWS) -> tuple[GBTClassificationModel | None, dict[str, DataFrame], float]:
    """Trees on distinct URLs that a rule labels, the statistics of all pages, and the share of blocked ones of those that a
    rule labels. Without labels of both kinds there are no trees: None."""
    tables, prior = statistics(pages, rules, url)
    if not 0 < prior < 1:
        return None, tables, prior
    labelled = located(pages.select(url), url).withColumn("verdict", rule_column(rules, lambda r: r.verdict)).filter("verdict is not null").select(url, "verdict").distinct()
    sample = labelled.withColumn("h", F.xxhash64(url)).orderBy("h", url, "verdict").limit(rows)
    sample = written(lexical(sample, url).withColumn("label", (F.col("verdict") == "block").cast("double")), "urls")
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxMemoryInMB=64)
    table = _vectors(sample, tables, prior, own_fold=True).select("features", "label").coalesce(1)
    return learner.fit(table), tables, prior


def _vectors(pages: DataFrame, tables: dict[str, DataFrame], prior: float, own_fold: bool = False) -> DataFrame:
    """pages with features: rates of all folds, or of those but a page's own."""
    for k, table in tables.items():
        rates = table.filter(F.col("fold").isNotNull() if own_fold else F.col("fold").isNull())
        on = [k, "fold"] if own_fold else [k]
        rates = rates.select(*on, f"{k}_count", f"{k}_rate")
        if rates.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            rates = F.broadcast(rates)
        pages = pages.join(rates, on, "left").fillna({f"{k}_rate": prior, f"{k}_count": 0.0})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(pages)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """Each page with host, path, rule, score (the trees' probability of block) and verdict.

    The longest rule that fits decides; else the trees block from a probability of 0.5 on. One row for each row
    of pages: null ids stay null, repeated rows repeat. A null url is judged as an empty one. With labels of one kind
    only, or none, pages without a rule get that kind's verdict, or allow. An empty table gives no rows. Other
    columns aren't read.
    """
    pages = pages.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"))
    model, tables, prior = train(pages, rules)
    seen = lexical(pages).withColumn("rule", rule_column(rules, lambda r: r.text)).withColumn("ruled", rule_column(rules, lambda r: r.verdict))
    if model is None:
        scored = seen.withColumn("score", F.lit(float(prior)))
    else:
        scored = model.transform(_vectors(seen, tables, prior)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 6, over all pages."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
