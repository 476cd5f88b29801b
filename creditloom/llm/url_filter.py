"""URL filters: fixed rules first, then logistic regression on hashed character n-grams of host and path.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased. Path: from there up to ``?``, ``#`` or
the end. A null url, or one without ``://``, has an empty host and path. A rule fits its host and all subdomains if the
path starts with the rule's path; of several, the longest wins. Other urls are judged by the model.

The model is trained on a labelled url table of at most ``TRAIN_URLS`` rows. Here the table holds urls that rules decide,
those of the smallest hashes, so it is the same on every run. Defined results: with no labelled url, or urls of one label
only, every other url gets that label (``allow`` where there is none); repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import read, staged

#: (verdict, rule as host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRAIN_URLS = 10_000
GRAM, FEATURES, THRESHOLD = 3, 4096, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path; two empty strings for null or where ``://`` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_columns(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """Rule text and its verdict, or nulls. Longer rules are tried first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: F.Column, path: F.Column) -> F.Column:
    """Character n-grams of host and path, with marks at the ends."""
    s = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (GRAM - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(GRAM)))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__x").transform(
        df.withColumn("__grams", grams(F.col("host"), F.col("path")))).drop("__grams")


def fit(labelled: DataFrame):
    """A model from a small table (host, path, verdict), or the only verdict that the table has, ``allow`` if it is empty."""
    seen = sorted(r.verdict for r in labelled.select("verdict").distinct().limit(3).collect())
    if len(seen) < 2:
        return seen[0] if seen else "allow"
    data = _features(labelled).select("__x", (F.col("verdict") == "block").cast("double").alias("__y"))
    return LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=40, regParam=0.01, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c").fit(data)


def judge(parsed: DataFrame, model) -> DataFrame:
    """Add block_score (chance of block, from 0 to 1) to a table with host and path."""
    if isinstance(model, str):
        return parsed.withColumn("block_score", F.lit(1.0 if model == "block" else 0.0))
    return model.transform(_features(parsed)).withColumn("block_score", vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__c")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score."""
    host, path = split_url(F.col(f"`{url_col}`"))
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("__says"))
    if labelled is None:
        labelled = (parsed.filter("rule is not null").select("host", "path", F.col("__says").alias("verdict")).distinct()
                    .orderBy(F.xxhash64("host", "path"), "host", "path").limit(TRAIN_URLS))
    scored = judge(parsed, fit(staged(labelled, "labelled_urls")))
    by_model = F.when(F.col("block_score") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__says", by_model).alias("verdict"), "block_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))
