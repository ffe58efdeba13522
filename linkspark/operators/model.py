"""Pair classification: folds by reference record, boosted trees per fold, and their mean."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators.config import ModelConfig
from linkspark.sources.storage import new_path, written


#: Folds trained at a time. A level of a tree is a short job that leaves cores idle; each fold's rows are held by Spark while it is trained.
AT_ONCE = 2


def group_fold(group: Column, folds: int = 5, seed: int = 42) -> Column:
    """A group's fold by hash, the same in any engine; all rows of a group share it."""
    return (F.conv(F.substring(F.md5(F.concat(group, F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("long")


def feature_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds a vector column ``features``; missing values count as 0."""
    filled = df.fillna(0, subset=list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled)


def _classifier(cfg: ModelConfig, fold: int) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=cfg.iterations, stepSize=cfg.step, maxDepth=cfg.depth, minInstancesPerNode=cfg.min_instances, maxBins=cfg.max_bins, featureSubsetStrategy=cfg.feature_subset, subsamplingRate=cfg.subsample, seed=cfg.seed + fold)


def positive(probability: Column) -> Column:
    return vector_to_array(probability)[1]


def train_oof(df: DataFrame, columns: Sequence[str], cfg: ModelConfig = ModelConfig()) -> tuple[DataFrame, list[GBTClassificationModel]]:
    """Out-of-fold probabilities (s1_id, cand_id, label, proba), and the models; no model saw the record it scores."""
    data = feature_matrix(df, columns).withColumn("fold", group_fold(F.col("s1_id"), cfg.folds, cfg.seed)).select("s1_id", "cand_id", "label", "features", "fold")
    data = written(data, "folds")
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # Spark then cuts no lineage of trees, which grows with each of them
        context.setCheckpointDir(new_path(df.sparkSession, "trees"))

    def fit(fold: int) -> GBTClassificationModel:
        return _classifier(cfg, fold).fit(data.filter(F.col("fold") != fold))

    with ThreadPool(AT_ONCE) as pool:
        models = pool.map(inheritable_thread_target(fit), range(cfg.folds), chunksize=1)
    scored = [model.transform(data.filter(F.col("fold") == fold)).select("s1_id", "cand_id", "label", positive(F.col("probability")).alias("proba")) for fold, model in enumerate(models)]
    return reduce(DataFrame.unionByName, scored), models


def predict(models: Sequence[GBTClassificationModel], df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(s1_id, cand_id, proba): the mean of the models' probabilities."""
    out, parts = feature_matrix(df, columns), []
    for k, model in enumerate(models):
        raw = [f"_raw{k}", f"_prob{k}", f"_pred{k}"]
        model = model.copy().setRawPredictionCol(raw[0]).setProbabilityCol(raw[1]).setPredictionCol(raw[2])
        out = model.transform(out).withColumn(f"_p{k}", positive(F.col(raw[1]))).drop(*raw)
        parts.append(F.col(f"_p{k}"))
    return out.select("s1_id", "cand_id", (sum(parts[1:], parts[0]) / len(parts)).alias("proba"))


def importance(models: Sequence[GBTClassificationModel], columns: Sequence[str]) -> list[tuple[str, float]]:
    """Columns by falling mean importance."""
    mean = [sum(float(m.featureImportances[k]) for m in models) / len(models) for k in range(len(columns))]
    return sorted(zip(columns, mean, strict=True), key=lambda x: (-x[1], x[0]))


def save(models: Sequence[GBTClassificationModel], path: str) -> None:
    for k, model in enumerate(models):
        PipelineModel([model]).write().overwrite().save(f"{path}/fold{k}")


def load(path: str, folds: int = 5) -> list[GBTClassificationModel]:
    return [PipelineModel.load(f"{path}/fold{k}").stages[0] for k in range(folds)]
