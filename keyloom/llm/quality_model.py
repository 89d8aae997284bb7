"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model (``ngrams``) learns from the whole texts of all documents labelled as good but for a fold that is held out.  Every
document of the corpus is scored whole.  A language's threshold is a high quantile of the perplexities of its trusted documents
of that fold, so documents that are as likely as nearly all trusted ones stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import ngrams
from keyloom.llm.shared import drop, freed, keep, spread, table, without
from keyloom.session import ship

QUANTILE = 0.999
LEARN_SHARE = 0.8  # of trusted documents; the others are the fold that sets thresholds
PARTS = 4  # of the documents, when texts to learn from are found
MIN_TRUSTED = 30  # a language with fewer trusted documents uses the threshold of all languages


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as good, each once, with a hash in [0, 1) by which folds are dealt.  Null ids and labels name nothing."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return good.select("_id", (F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000)) / 1e6).alias("_draw"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Perplexity and verdict for each document.

    Input: documents with ``doc_id``, ``text``, ``lang``, labels with ``doc_id``, ``quality``; other columns are ignored.  Output:
    ``doc_id``, ``lang``, ``n_tokens``, ``perplexity``, ``threshold`` (the language's ``quantile``), ``kept``.

    Null and empty texts are one token, the end, and judged like any document.  A null language is a
    language of its own.  A language without enough trusted documents uses the threshold of all, and without
    any trusted document everything is kept.  Rows that repeat an id are scored one by one; an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "lang", "text")
    with freed(docs.sparkSession):
        trusted = keep(trusted_ids(labels), "quality-trusted")
        learn = trusted.where(F.col("_draw") < LEARN_SHARE)
        # texts are shuffled a part at a time, which bounds the disk
        some = lambda i: docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == i)
        kept = [keep(some(i).join(learn, F.col("doc_id") == F.col("_id"), "left_semi").select("text"), "quality-texts") for i in range(PARTS)]
        texts = reduce(DataFrame.union, kept)
        values, unseen = ngrams.gram_values(texts)
        drop(texts)
        scored = keep(ngrams.score(docs, values, unseen), "quality-scores").withColumn("level", -F.col("log10") / F.col("n_tokens"))
        drop(values)

    outside = trusted.where(F.col("_draw") >= LEARN_SHARE)
    judged = scored.join(outside, F.col("doc_id") == F.col("_id"), "left_semi")
    cut = F.percentile_approx("level", quantile, 10_000)
    by_lang = keep(judged.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), cut.alias("_cut")).where(F.col("_n") >= MIN_TRUSTED).drop("_n"), "quality-cuts")
    overall = judged.agg(cut).first()[0]
    rows = spread(scored, by_lang, "lang", by_lang.count(), F.col("doc_id"))
    limit = F.coalesce(F.col("_cut"), F.lit(overall).cast("double"))
    kept = F.coalesce(F.col("level") <= limit, F.lit(True))
    return rows.select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), "level").alias("perplexity"), F.pow(F.lit(10.0), limit).alias("threshold"), kept.alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns, whatever their names.

    Null and empty texts are judged as ``classify`` says.  Of rows that repeat an id, or have none, all stay if any is kept.  An
    empty table gives an empty result."""
    judged = classify(docs, labels, **options).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return without(docs, judged.where("not kept"))


def op8_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
