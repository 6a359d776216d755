"""The fixed family of classifiers, in registry order, and scoring with fitted ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.calibration import fit_sigmoid
from cohortlens.operators.votes import p_col, yhat_col


def score_col(model: str) -> str:
    """Column with the value a calibrator is fitted on: margin or probability."""
    return f"s__{model}"


@dataclass(frozen=True)
class ModelSettings:
    """Settings shared by all fits. Defaults follow the classifiers' usual ones.

    Spark grows trees to depth 30 at most. A tree has up to two nodes per row it was
    fitted on and lives on the driver: on large data bound ``max_fit_rows``. A fit
    then uses a seeded sample of about that many rows with the same share of each class.
    """

    tree_depth: int = 30
    forest_trees: int = 100
    forest_depth: int = 30
    max_bins: int = 256
    max_fit_rows: int | None = None
    logistic_iterations: int = 1500
    logistic_c: float = 1.0
    stump_rounds: int = 100
    stump_rate: float = 1.0
    hidden_units: int = 100
    network_iterations: int = 1800
    boosting_rounds: int = 100
    boosting_depth: int = 6
    boosting_rate: float = 0.3
    svm_c: float = 1.0
    svm_components: int = 200
    svm_iterations: int = 100


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol):
    """Random cosine features whose inner products approximate an RBF kernel (Rahimi and Recht, 2007)."""

    def __init__(self, input_col: str, output_col: str, n_inputs: int, n_components: int, gamma: float, seed: int = 0):
        super().__init__()
        self._set(inputCol=input_col, outputCol=output_col)
        rng = np.random.default_rng(seed)
        self.weights = rng.normal(scale=np.sqrt(2 * gamma), size=(n_inputs, n_components))
        self.offsets = rng.uniform(0, 2 * np.pi, size=n_components)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, offsets = self.weights, self.offsets
        scale = np.sqrt(2.0 / weights.shape[1])

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return rows
            return pd.Series(list(scale * np.cos(np.vstack(rows.to_numpy()) @ weights + offsets)))

        return dataset.withColumn(
            self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol())))
        )


@dataclass(frozen=True)
class Algorithm:
    """``build(settings, n_rows, n_features)`` gives an estimator on columns ``features`` and ``y``.

    ``margin`` says that calibrators and votes of this model start from the raw margin.
    ``probability`` is false where Spark's model has no probabilities of its own.
    """

    ordinal: int
    name: str
    build: Callable[[ModelSettings, int, int], Estimator]
    margin: bool = False
    probability: bool = True


def _scaled(stages: list, source: str = "features", target: str = "scaled") -> Pipeline:
    scaler = StandardScaler(inputCol=source, outputCol=target, withMean=True, withStd=True)
    return Pipeline(stages=[scaler, *stages])


def _tree(s: ModelSettings, n: int, d: int) -> Estimator:
    return DecisionTreeClassifier(labelCol="y", maxDepth=s.tree_depth, impurity="gini", seed=0, maxMemoryInMB=512, maxBins=s.max_bins)


def _forest(s: ModelSettings, n: int, d: int) -> Estimator:
    return RandomForestClassifier(
        labelCol="y", numTrees=s.forest_trees, maxDepth=s.forest_depth, featureSubsetStrategy="sqrt", seed=0,
        maxMemoryInMB=1024, maxBins=s.max_bins,
    )


def _logistic(s: ModelSettings, n: int, d: int) -> Estimator:
    # Spark averages the loss over rows: penalty 1 / (C n) matches an unaveraged loss with weight C
    return LogisticRegression(
        labelCol="y", maxIter=s.logistic_iterations, regParam=1.0 / (s.logistic_c * max(n, 1)), elasticNetParam=0.0,
        standardization=False,
    )


def _stumps(s: ModelSettings, n: int, d: int) -> Estimator:
    return GBTClassifier(labelCol="y", maxIter=s.stump_rounds, stepSize=s.stump_rate, maxDepth=1, seed=0, maxBins=s.max_bins)


def _network(s: ModelSettings, n: int, d: int) -> Estimator:
    # sigmoid units saturate on raw scales, so inputs are standardised first
    return _scaled([MultilayerPerceptronClassifier(
        featuresCol="scaled", labelCol="y", layers=[d, s.hidden_units, 2], maxIter=s.network_iterations, seed=1)])


def _svm(s: ModelSettings, n: int, d: int) -> Estimator:
    return _scaled([
        RandomFourierFeatures("scaled", "kernel", d, s.svm_components, 1.0 / d, seed=0),
        LinearSVC(featuresCol="kernel", labelCol="y", maxIter=s.svm_iterations, regParam=1.0 / (s.svm_c * max(n, 1)),
                  standardization=False),
    ])


def _boosted(s: ModelSettings, n: int, d: int) -> Estimator:
    return GBTClassifier(
        labelCol="y", maxIter=s.boosting_rounds, maxDepth=s.boosting_depth, stepSize=s.boosting_rate, seed=0,
        maxBins=s.max_bins)


#: the order breaks ties between equally good models (fixed value)
REGISTRY: tuple[Algorithm, ...] = (
    Algorithm(0, "dt", _tree),
    Algorithm(1, "rf", _forest),
    Algorithm(2, "log-reg", _logistic, margin=True),
    Algorithm(3, "gb", _stumps, margin=True),
    Algorithm(4, "mlp", _network),
    Algorithm(5, "svm", _svm, margin=True, probability=False),
    Algorithm(6, "xgb", _boosted),
)
ALGORITHMS = {a.name: a for a in REGISTRY}


def algorithms(names: Sequence[str] | None = None) -> list[Algorithm]:
    """The named algorithms, in registry order."""
    if names is None:
        return list(REGISTRY)
    unknown = set(names) - set(ALGORITHMS)
    if unknown:
        raise ValueError(f"unknown algorithm(s) {sorted(unknown)}; expected {list(ALGORITHMS)}")
    return [a for a in REGISTRY if a.name in names]


@dataclass(frozen=True)
class Fitted:
    """A fitted classifier. ``model`` is None where the training rows held a single class."""

    algorithm: Algorithm
    model: Transformer | None
    sigmoid: tuple[float, float] | None = None

    def score(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Add probability, class and calibration score of every row under ``name``."""
        name = name or self.algorithm.name
        kept = df.columns
        if self.model is None:
            nan = F.lit(float("nan"))
            return df.withColumns({p_col(name): nan, score_col(name): nan, yhat_col(name): F.lit(0)})
        out = self.model.transform(df)
        margin = vector_to_array("rawPrediction")[1]
        if self.algorithm.probability:
            p: Column = vector_to_array("probability")[1]
            yhat = F.when(p > 0.5, 1).otherwise(0)
        else:
            a, b = self.sigmoid
            p = 1 / (1 + F.exp(margin * F.lit(a) + F.lit(b)))
            yhat = F.when(margin > 0, 1).otherwise(0)
        score = margin if self.algorithm.margin else p
        return out.select(*kept, p.alias(p_col(name)), score.alias(score_col(name)), yhat.alias(yhat_col(name)))


def fit(
    algorithm: Algorithm, df: DataFrame, counts: tuple[int, int], n_features: int,
    settings: ModelSettings = ModelSettings(),
) -> Fitted:
    """Fit on ``features`` and ``y``. ``counts`` are the rows of class 0 and 1, known from the fold table."""
    if min(counts) == 0:
        return Fitted(algorithm, None)
    n = sum(counts)
    if settings.max_fit_rows is not None and n > settings.max_fit_rows:
        share = settings.max_fit_rows / n
        df = df.sampleBy("y", {0: share, 1: share}, seed=0)
        n = settings.max_fit_rows
    model = algorithm.build(settings, n, n_features).fit(df)
    if algorithm.probability:
        return Fitted(algorithm, model)
    row = fit_sigmoid(_held_out_margins(algorithm, df, n, n_features, settings), []).first()
    return Fitted(algorithm, model, (row["a"], row["b"]))


def _held_out_margins(algorithm: Algorithm, df: DataFrame, n: int, n_features: int, settings: ModelSettings) -> DataFrame:
    """Margins of each half of the rows by a machine fitted on the other one; ``score`` and ``y``."""
    df = df.select("features", "y").withColumn("half", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(2)))
    classes = {(r["half"], r["y"]) for r in df.select("half", "y").distinct().collect()}
    parts = []
    for half in (0, 1):
        # rows that are all alike, or too few, can't be held out: they are scored by the machine fitted on all
        fit_on = df.where(F.col("half") != half) if {(1 - half, 0), (1 - half, 1)} <= classes else df
        model = algorithm.build(settings, max(1, n // 2), n_features).fit(fit_on.select("features", "y"))
        parts.append(model.transform(df.where(F.col("half") == half)).select(vector_to_array("rawPrediction")[1].alias("score"), "y"))
    return parts[0].unionByName(parts[1])


def score_all(fitted: Sequence[Fitted], df: DataFrame) -> DataFrame:
    """Side-by-side scores of several models: one pass over the rows."""
    for f in fitted:
        df = f.score(df)
    return df
