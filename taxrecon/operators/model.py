"""Vendor risk model over table- and graph-derived features."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources import sinks
from ..sources.storage import written
from . import quantiles

FEATURES = ["mismatch_count", "total_tax_at_risk", "filing_delay_days", "graph_centrality", "transaction_volume", "community_cluster", "einvoice_compliance_rate", "state_risk_factor"]
# What a vendor without the fact has.
DEFAULTS = {"mismatch_count": 0.0, "total_tax_at_risk": 0.0, "filing_delay_days": 0.0, "graph_centrality": 0.5, "transaction_volume": 0.0, "community_cluster": 0.0, "einvoice_compliance_rate": 0.9, "state_risk_factor": 0.5}
#: Parameter: rows of a task while forests are trained.
ROWS = 4_000


def features(vendors: DataFrame, invoices: DataFrame, centrality: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """vendor_id and the eight features, tax in rupees. centrality (vendor_id, rank) and clusters (vendor_id,
    community) are optional; vendors without a fact get its default. One aggregation over the invoices."""
    bad = F.col("match_status") != scoring.MATCHED
    facts = invoices.groupBy("vendor_id").agg(F.count_if(bad).alias("mismatch_count"), (F.sum(F.when(bad, F.col("total_tax")).otherwise(0)).cast("double") / 100).alias("total_tax_at_risk"), F.count("*").alias("transaction_volume"), (F.count_if("valid_einvoice").cast("double") / F.count("*")).alias("einvoice_compliance_rate"))
    states = invoices.groupBy(F.col("vendor_state").alias("state")).agg((F.count_if(bad).cast("double") / F.count("*")).alias("state_risk_factor"))
    out = vendors.select("vendor_id", "state", F.col("avg_days_late").alias("filing_delay_days")).join(facts, "vendor_id", "left").join(states, "state", "left")
    for side, col, name in ((centrality, "rank", "graph_centrality"), (clusters, "community", "community_cluster")):
        if side is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
        elif name == "community_cluster":
            # Communities are numbered in the order of their names, from counts per range of names.
            numbers = sinks.ranked(side.select(col).distinct(), name, [F.col(col)]).withColumn(name, F.col(name).cast("double"))
            out = out.join(side.join(numbers, col).select("vendor_id", name), "vendor_id", "left")
        else:
            out = out.join(side.select("vendor_id", F.col(col).alias(name)), "vendor_id", "left")
    return out.select("vendor_id", *(F.coalesce(F.col(c).cast("double"), F.lit(DEFAULTS[c])).alias(c) for c in FEATURES))


def heuristic(rows: DataFrame) -> DataFrame:
    """rows with risk, a weighted score of the features."""
    most = rows.agg(F.max("transaction_volume").alias("most"))
    c = F.col
    score = c("mismatch_count") * F.lit(0.25) + c("total_tax_at_risk") / F.lit(100000.0) * F.lit(0.20) + c("filing_delay_days") * F.lit(0.15) + c("graph_centrality") * F.lit(0.10) + (F.lit(1.0) - c("einvoice_compliance_rate")) * F.lit(0.15) + (F.lit(1.0) - c("transaction_volume") / c("most")) * F.lit(0.05) + c("state_risk_factor") * F.lit(0.10)
    return rows.crossJoin(F.broadcast(most)).withColumn("risk", score).drop("most")


def labelled(rows: DataFrame, quantile: float = 0.7) -> DataFrame:
    """label 1 where the heuristic score is above its quantile (strictly)."""
    scored = written(heuristic(rows))
    return scored.withColumn("label", (F.col("risk") > F.lit(quantiles.quantile(scored, "risk", quantile))).cast("double"))


def split(rows: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """By a hash of the key, so the same rows fall on the same side however they are stored."""
    u = F.pmod(F.xxhash64(F.lit(seed), "vendor_id"), F.lit(10_000))
    return rows.filter(u < int(share * 10_000)), rows.filter(u >= int(share * 10_000))


def weighted(rows: DataFrame) -> DataFrame:
    """Balanced class weights n / (2 * n_class)."""
    n = rows.agg(F.count("*").alias("n"))
    per = rows.groupBy("label").agg(F.count("*").alias("n_class"))
    weights = per.crossJoin(n).select("label", (F.col("n") / (F.col("n_class") * 2)).alias("w"))
    return rows.join(F.broadcast(weights), "label")  # two rows


def spread(rows: DataFrame) -> DataFrame:
    """rows in tasks of about ROWS by their key and in its order, so a forest, whose samples are drawn by task, takes the
    same ones however the rows are stored, and large tables are trained on by all executors: as stored they may be one file."""
    return rows.repartition(max(1, -(-rows.count() // ROWS)), "vendor_id").sortWithinPartitions("vendor_id")


def pipeline(trees: int = 100, depth: int = 8, leaf: int = 5, seed: int = 42, boosted: bool = False) -> Pipeline:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if boosted:
        return Pipeline(stages=[assembler, GBTClassifier(maxDepth=min(depth, 5), minInstancesPerNode=leaf, weightCol="w", seed=seed, maxIter=20)])
    return Pipeline(stages=[assembler, RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, weightCol="w", seed=seed)])


def train(rows: DataFrame, **kw) -> PipelineModel:
    """A forest on labelled rows."""
    return pipeline(**kw).fit(spread(weighted(rows)))


def metrics(model: PipelineModel, test: DataFrame) -> dict[str, float]:
    """Accuracy, area under ROC, and precision, recall and F1 of the positive class."""
    out = model.transform(test)
    found = {"auc": BinaryClassificationEvaluator().evaluate(out), "accuracy": MulticlassClassificationEvaluator(metricName="accuracy").evaluate(out)}
    for name in ("precisionByLabel", "recallByLabel", "fMeasureByLabel"):
        found[name] = MulticlassClassificationEvaluator(metricName=name, metricLabel=1.0).evaluate(out)
    return found


def confusion(model: PipelineModel, test: DataFrame) -> DataFrame:
    return model.transform(test).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def evaluated(rows: DataFrame, seed: int = 42) -> DataFrame:
    """model, metric, value of a forest and of boosted trees, trained on one side of the split and measured on the
    other; a handful of rows."""
    train_, test = split(rows, seed=seed)
    found = [(name, k, float(v)) for name, boosted in (("forest", False), ("boosted", True)) for k, v in sorted(metrics(train(train_, boosted=boosted), test).items())]
    return rows.sparkSession.createDataFrame(found, "model string, metric string, value double")


def folded(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold, by a hash of the key, so however the rows are stored a vendor is in the same one."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.lit("fold"), "vendor_id"), F.lit(folds)).cast("int"))


def cross_validated(rows: DataFrame, folds: int = 5, **kw) -> float:
    """Mean area under ROC over folds."""
    cv = CrossValidator(estimator=pipeline(**kw), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="fold")
    return cv.fit(spread(weighted(folded(rows, folds)))).avgMetrics[0]


def out_of_fold(rows: DataFrame, folds: int = 5, **kw) -> DataFrame:
    """vendor_id, fold, label, probability of every row by the forest that was trained on the other folds."""
    held = written(folded(rows, folds))
    parts = [predict(train(held.filter(F.col("fold") != k), **kw), held.filter(F.col("fold") == k)).select("vendor_id", "probability") for k in range(folds)]
    return held.select("vendor_id", "fold", "label").join(reduce(DataFrame.unionByName, parts), "vendor_id")


def fold_metrics(predictions: DataFrame, folds: int = 5) -> DataFrame:
    """fold, n, accuracy and auc of predictions of out_of_fold(); the row with fold -1 is over all of them."""
    held = written(predictions)
    right = ((F.col("probability") > 0.5) == (F.col("label") > 0)).cast("double")

    def of(rows: DataFrame, k: int) -> DataFrame:
        return rows.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy")).crossJoin(quantiles.auc(rows, "probability", "label")).select(F.lit(k).alias("fold"), "n", "accuracy", "positives", "auc")

    return reduce(DataFrame.unionByName, [of(held, -1), *(of(held.filter(F.col("fold") == k), k) for k in range(folds))])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).select("vendor_id", p.alias("probability"), scoring.probability_label(p).alias("risk_label"), "prediction")


def importances(model: PipelineModel, spark) -> DataFrame:
    """The features by importance; a handful of rows."""
    found = sorted(zip(FEATURES, (float(x) for x in model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: -x[1])
    return spark.createDataFrame(found, "feature string, importance double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
