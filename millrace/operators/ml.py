"""Candidate regressions with Spark ML: one preprocessing, several models, compared and selected."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Growth, HistogramBooster
from .features import impute_constant, regression_metrics

LOWER_IS_BETTER = {"mae", "rmse", "mape"}


@dataclass(frozen=True)
class Task:
    """What is predicted from what."""

    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    seed: int = 42

    def prepared(self, df: DataFrame) -> DataFrame:
        df = df.select(*(F.col(c).cast("double").alias(c) for c in (*self.numeric, self.target) if c in df.columns), *(F.col(c).cast("string").alias(c) for c in self.categorical), *(c for c in df.columns if c not in (*self.numeric, *self.categorical, self.target)))
        return impute_constant(df, list(self.categorical))

    def stages(self) -> list:
        """Median, deviation, one slot for each known category (an unknown one has none)."""
        filled = [f"{c}_filled" for c in self.numeric]
        out = [Imputer(strategy="median", inputCols=list(self.numeric), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="numbers"), StandardScaler(withMean=True, withStd=True, inputCol="numbers", outputCol="scaled")]
        slots = []
        if self.categorical:
            indexed, slots = [f"{c}_index" for c in self.categorical], [f"{c}_slots" for c in self.categorical]
            out += [StringIndexer(inputCols=list(self.categorical), outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=slots)]
        return [*out, VectorAssembler(inputCols=["scaled", *slots], outputCol="features")]


def effective_task(task: Task, df: DataFrame, enriched: tuple[str, ...]) -> Task:
    """The task with those enriched columns as further numeric features that survived in ``df``."""
    return replace(task, numeric=(*task.numeric, *(c for c in enriched if c in df.columns and c not in task.numeric)))


def save_model(spark: SparkSession, model: PipelineModel, folder: str, metadata: dict) -> None:
    """The fitted model and a JSON file that tells about it, both replaced."""
    model.write().overwrite().save(f"{folder}/model")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    """(model, metadata) of ``save_model``; without metadata an empty one, without a model an error."""
    try:
        rows = spark.read.text(f"{folder}/metadata").collect()
    except AnalysisException:
        rows = []
    try:
        return PipelineModel.load(f"{folder}/model"), json.loads(rows[0]["value"]) if rows else {}
    except Exception as e:
        if "Input path does not exist" in str(e) or "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no saved model in {folder}") from e
        raise


def candidates(task: Task, trees: int = 120, boost_rounds: int = 150, strong_rounds: int = 300) -> dict:
    """Models by name. ``strong_rounds``: trees of the two boosters on histograms, level by level and leaf by leaf; 0 leaves them out."""
    shared = {"featuresCol": "features", "labelCol": task.target}
    found = {
        "linear": LinearRegression(**shared),
        "forest": RandomForestRegressor(**shared, numTrees=trees, maxDepth=16, minInstancesPerNode=10, seed=task.seed),
        "boosted": GBTRegressor(**shared, maxIter=boost_rounds, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=task.seed),
    }
    if strong_rounds:
        found["levelwise"] = HistogramBooster(**shared, growth=Growth(trees=strong_rounds, depth=6, row_share=0.8, column_share=0.8, seed=task.seed))
        found["leafwise"] = HistogramBooster(**shared, growth=Growth(trees=strong_rounds, leaves=31, ridge=0.0, least_rows=20, column_share=0.8, seed=task.seed))
    return found


@dataclass
class Trained:
    models: dict[str, PipelineModel] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def spread(rows: DataFrame, least: int = 16384) -> DataFrame:
    """Rows that lie in few partitions, as a small file's do, dealt to all cores, ``least`` rows to each at least."""
    parts, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    wanted = min(cores, rows.count() // least) if parts < cores else 0
    return rows.repartition(wanted) if wanted > parts else rows


def fit_all(task: Task, train: DataFrame, models: dict) -> Trained:
    """Preprocessing is fitted once; each model is fitted on its output, timed. Boosters of as many bins share these; the first one's time has them."""
    ready = Pipeline(stages=task.stages()).fit(task.prepared(train).dropna(subset=[task.target]))
    rows = spread(ready.transform(task.prepared(train).dropna(subset=[task.target])).select("features", task.target)).cache()
    out, held = Trained(), {}

    def fitted(model):
        if not isinstance(model, HistogramBooster):
            return model.fit(rows)
        bins = model.growth.bins
        if bins not in held:
            held[bins] = model.binned(rows)
        return model.fit_binned(held[bins])

    for name, model in models.items():
        began = time.time()
        out.models[name] = PipelineModel(stages=[ready, fitted(model)])
        out.seconds[name] = time.time() - began
    rows.unpersist()
    return out


def compare(task: Task, trained: Trained, test: DataFrame) -> DataFrame:
    """name, seconds (of training), mae, rmse, r2, mape of each model."""
    named = lambda n: (F.lit(n).alias("name"), F.lit(trained.seconds.get(n)).cast("double").alias("seconds"))
    parts = [regression_metrics(m.transform(task.prepared(test)), task.target, "prediction").select(*named(n), "*") for n, m in trained.models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_best(results: DataFrame, metric: str = "rmse") -> DataFrame:
    """name and score of the best model by a metric."""
    if metric not in {"mae", "rmse", "r2", "mape"}:
        raise ValueError(f"unknown metric {metric!r}")
    pick = F.min_by if metric in LOWER_IS_BETTER else F.max_by
    best = F.min if metric in LOWER_IS_BETTER else F.max
    return results.agg(pick("name", metric).alias("name"), best(metric).alias("score"))


def envelope(predictions: DataFrame, column: str = "prediction") -> DataFrame:
    """Adds status: SUCCESS for finite predictions, else NO_PREDICTION."""
    c = F.col(column)
    return predictions.withColumn("status", F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), "SUCCESS").otherwise("NO_PREDICTION"))
