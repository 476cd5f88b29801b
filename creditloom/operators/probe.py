"""Proxy probe: can a protected attribute be predicted from what the state shows?

One-vs-rest L2 logistic regressions over stratified folds with Spark ML; AUC from score histograms. The folds' distributed
fits run side by side, since a step of one of them is a job of a fraction of a second; no row ever reaches the driver.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import reference as R
from creditloom.functions.ranks import auc
from creditloom.operators.features import STATE_COLUMNS, STATE_NUMERIC


def assembled(state: DataFrame, keep: list[str]) -> DataFrame:
    """Numeric fields as they are and one-hot categories (bounded vocabularies) as one vector ``raw``."""
    cats = [x for x in STATE_COLUMNS if x not in STATE_NUMERIC]
    df = state.select(*keep, *[F.col(x).cast("double") for x in STATE_NUMERIC],
                      *[F.coalesce(F.col(x).cast("string"), F.lit("none")).alias(x) for x in cats]).fillna(0.0)
    stages = [StringIndexer(inputCols=cats, outputCols=[f"{x}_i" for x in cats], handleInvalid="keep"),
              OneHotEncoder(inputCols=[f"{x}_i" for x in cats], outputCols=[f"{x}_v" for x in cats]),
              VectorAssembler(inputCols=[*STATE_NUMERIC, *[f"{x}_v" for x in cats]], outputCol="raw")]
    return Pipeline(stages=stages).fit(df).transform(df).select(*keep, "raw")


def standardised(vectors: DataFrame) -> DataFrame:
    """``raw`` vectors divided by the deviation of each of their places, as ``features``."""
    return StandardScaler(inputCol="raw", outputCol="features", withMean=False).fit(vectors).transform(vectors).drop("raw")


def state_vectors(state: DataFrame, keep: list[str]) -> DataFrame:
    """The vectors of a state, standardised."""
    return standardised(assembled(state, keep))


def proxy_probe(state: DataFrame, attribute: str, folds: int = 5, tolerance: float = 1e-4, vectors: DataFrame | None = None) -> DataFrame:
    """Macro one-vs-rest AUC of an attribute over held-out folds.

    ``vectors`` are the state's vectors with k and the attribute, where several attributes of one state share them.
    """
    vectors = (state_vectors(state, ["k", attribute]) if vectors is None else vectors).select("k", attribute, "features")
    vectors = vectors.withColumn("fold", F.pmod(F.xxhash64("k", F.lit(71)), F.lit(folds)))
    spark = state.sparkSession
    vectors = vectors.persist()
    try:
        classes = sorted(r[0] for r in vectors.select(attribute).distinct().collect())  # one row per attribute value
        if len(classes) < 2:
            return spark.sql(f"SELECT '{attribute}' AS attribute, CAST(NULL AS DOUBLE) AS auc_macro_ovr, 'INSUFFICIENT_N' AS status")
        label = F.lit(-1.0)
        for i, v in enumerate(classes):
            label = F.when(F.col(attribute) == v, float(i)).otherwise(label)
        data = vectors.withColumn("label", label)

        def scores(fold: int) -> DataFrame:
            # one multinomial fit per fold scores every class at once; each class is then judged one against the rest
            fit = LogisticRegression(regParam=0.01, maxIter=1000, tol=tolerance, family="multinomial", standardization=False).fit(data.filter(F.col("fold") != fold))
            return fit.transform(data.filter(F.col("fold") == fold)).select(
                F.lit(fold).alias("fold"), "label", F.posexplode(vector_to_array("probability")).alias("cls", "p"))

        with ThreadPool(folds) as pool:
            scored = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(scores), range(folds)))
        per = auc(scored, ["fold", "cls"], "p", F.col("label") == F.col("cls"))
        macro = per.groupBy("cls").agg(F.avg("auc").alias("auc")).agg(F.avg("auc").alias("auc_macro_ovr"))
        out = macro.select(F.lit(attribute).alias("attribute"), "auc_macro_ovr", F.when(
            F.col("auc_macro_ovr").isNull(), "INSUFFICIENT_N").when(F.col("auc_macro_ovr") > R.PROBE_AUC_MAX, "FAIL").otherwise("PASS").alias("status"))
        value = out.first()  # a single metric row
        return spark.createDataFrame([tuple(value)], "attribute string, auc_macro_ovr double, status string")
    finally:
        vectors.unpersist()
