"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs; by default those are the URLs that a rule fits, labelled by the
rule.  A suffix's block rate is known to a training URL only from the other folds of the labelled URLs, so that it
says as much about the URL's label as it will about a URL that nobody labelled.  Everything runs as DataFrame
expressions and Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import keep, table
from keyloom.llm.words import ascii_lower

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS = 20_000  # about so many labelled URLs are used for training; bounds the suffix tables too
SMOOTH = 20.0
FOLDS = 5  # of the labelled URLs, by a hash of the URL
FEATURES = (
    "length", "host_length", "host_labels", "depth", "path_length", "digit_ratio", "entropy", "params", "query_length",
    "hyphens", "longest_part", "has_fragment", "suffix_rate", "domain_rate", "section_rate",
)


RATED = ("suffix", "domain", "section")  # ends of the host, and the path's first part


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null.  Meant for short rule lists."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[F.when(fits(host, path, h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest])


def _entropy(text: Column) -> Column:
    n = F.length(text).cast("double")

    def add(total: Column, char: Column) -> Column:
        p = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - p * F.log2(p)

    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, and the parts whose statistics complete them."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.split(F.concat_ws("/", "host", "path"), "[/.]")
    double = {
        "length": F.length(url),
        "host_length": F.length("host"),
        "host_labels": F.size(F.split("host", r"\.")),
        "depth": F.regexp_count("path", F.lit("/")),
        "path_length": F.length("path"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": _entropy(url),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "hyphens": F.regexp_count(url, F.lit("[-_]")),
        "longest_part": F.array_max(F.transform(parts, F.length)),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return pages.withColumns({k: v.cast("double") for k, v in double.items()}).withColumns(
        {"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "section": F.substring_index(F.substring("path", 2, 64), "/", 1)}
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(29)), F.lit(FOLDS)).cast("int")


class UrlModel:
    """Boosted trees and the block rates of host suffixes, learnt from ``labelled(url, host, path, blocked)``."""

    def __init__(self, labelled: DataFrame, rounds: int = 10, depth: int = 4, seed: int = 7):
        train = keep(labelled.select("url", "host", "path", "blocked"), "url-train")
        n, blocked = train.agg(F.count(F.lit(1)), F.sum("blocked")).first()
        self.prior, self.model, self.rates = (blocked or 0) / max(n, 1), None, {}
        if not n or blocked in (0, n):
            return
        full = lexical(train).withColumn("_fold", _fold())
        for key in RATED:
            in_fold = lambda x: F.array(*[F.sum(F.when(F.col("_fold") == i, x).otherwise(0)) for i in range(FOLDS)])
            counts = full.groupBy(key).agg(
                F.sum("blocked").alias("_hits"), F.count(F.lit(1)).alias("_seen"), in_fold(F.col("blocked")).alias("_fold_hits"), in_fold(F.lit(1)).alias("_fold_seen")
            )
            self.rates[key] = keep(counts, f"url-{key}")
        self.assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        rows = self.assemble.transform(self._rated(full, F.col("_fold"))).select("features", F.col("blocked").cast("double").alias("label"))
        self.model = GBTClassifier(maxIter=rounds, maxDepth=depth, minInstancesPerNode=5, seed=seed, maxMemoryInMB=64).fit(rows)

    def _rated(self, rows: DataFrame, fold: Column | None = None) -> DataFrame:
        """Smoothed block rates of suffixes, in hundredths, so that folds of one suffix hardly differ; a training row's
        fold does not count for it.  The tables have one row a suffix of the bounded training sample, which bounds
        what is broadcast."""
        for key, rates in self.rates.items():
            rows = rows.join(F.broadcast(rates), key, "left")
            less = (lambda c: F.get(c, fold)) if fold is not None else (lambda c: F.lit(0))
            seen, hits = F.coalesce(F.col("_seen") - less(F.col("_fold_seen")), F.lit(0)), F.coalesce(F.col("_hits") - less(F.col("_fold_hits")), F.lit(0))
            rate = F.round((hits + F.lit(SMOOTH * self.prior)) / (seen + F.lit(SMOOTH)), 2)
            rows = rows.withColumn(f"{key}_rate", rate).drop("_seen", "_hits", "_fold_seen", "_fold_hits")
        return rows

    def score(self, pages: DataFrame) -> DataFrame:
        """Adds ``block_score`` between 0 and 1."""
        if self.model is None:
            return pages.withColumn("block_score", F.lit(float(self.prior)))
        rows = self.model.transform(self.assemble.transform(self._rated(lexical(pages))))
        return rows.select(*pages.columns, vector_to_array("probability")[1].alias("block_score"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, labelled_urls: DataFrame | None = None) -> DataFrame:
    """Verdicts for every URL.

    Input: ``page_id``, ``url``; other columns are ignored.  Output: ``page_id``, ``host``, ``path``, ``rule`` (null if none
    fits), ``verdict`` (``allow`` or ``block``), ``block_score``.  Trees train on the URLs that a rule fits and on
    ``labelled_urls(url, blocked)``, or, if these are more than ``train_rows``, on about so many, chosen by a hash of the URL.

    A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the trees
    like any other.  If the rules label no URL, or all alike, the share of blocked labels (0 without labels)
    is the score of the rest.  Repeated rows get equal verdicts; an empty table gives an empty result.
    """
    url = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = url.withColumn("_fit", first_rule(F.col("host"), F.col("path"), rules))
    labelled = ruled.where("_fit is not null").select("url", "host", "path", (F.col("_fit.verdict") == "block").cast("int").alias("blocked"))
    if labelled_urls is not None:
        also = labelled_urls.where("blocked IS NOT NULL").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int"))
        labelled = labelled.unionByName(also)
    share = train_rows / max(labelled.count(), train_rows)
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    scored = UrlModel(labelled).score(ruled)
    learnt = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), learnt).alias("verdict"), "block_score")


#: Host, path and rule of every URL in plain SQL, for a test: verdicts without a rule come from the trees.
RULES_SQL = """
WITH u AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM u), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
  FROM h
)
SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
  END AS rule
FROM p
"""


def op2_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
