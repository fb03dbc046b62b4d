"""Tree regressors on feature tables: fit, grouped tuning, and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.hashing import unit_hash
from terrafold.operators.sampling import shuffled_index
from terrafold.session import cut_lineage


def make_pipeline(features: list[str], label: str, kind: str = "rf", **params) -> Pipeline:
    cls = {"rf": RandomForestRegressor, "gbt": GBTRegressor}[kind]
    model = cls(featuresCol="features", labelCol="_label", predictionCol="_pred", seed=42, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model])


def with_label(df: DataFrame, label: str, log: bool = True) -> DataFrame:
    v = F.col(label).cast("double")
    return df.withColumn("_label", F.log1p(F.greatest(v, F.lit(0.0))) if log else v)


def fit_regressor(df: DataFrame, features: list[str], label: str, kind: str = "rf", log: bool = True, **params) -> PipelineModel:
    """Random forest or boosted trees, on the log of the target by default."""
    train = cut_lineage(with_label(df, label, log).select(*features, "_label"))
    return make_pipeline(features, label, kind, **params).fit(train)


def grid_predict(model: PipelineModel, df: DataFrame, out: str, log: bool = True) -> DataFrame:
    """Score every row; predictions are back-transformed and floored at 0."""
    p = model.transform(df)
    v = F.expm1("_pred") if log else F.col("_pred")
    return p.withColumn(out, F.greatest(v, F.lit(0.0))).select(*df.columns, out)


def split_by_group(df: DataFrame, group: list[str], test: float = 0.2, seed: int = 0) -> DataFrame:
    """Mark whole groups, such as coarse cells, as train or test by their hash."""
    u = unit_hash(*[F.col(c) for c in group], seed=seed)
    return df.withColumn("split", F.when(u < test, "test").otherwise("train"))


def require_features(df: DataFrame, features: list[str]) -> DataFrame:
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features absent: {missing}")
    return df


def tune_regressor(
    df: DataFrame, features: list[str], label: str, group: str, depths: list[int], trees: list[int], folds: int = 5, log: bool = True,
    parallelism: int = 4,
) -> tuple[DataFrame, PipelineModel]:
    """Mean RMSE of a parameter grid, with folds that keep a group whole, and the best model fitted to all rows."""
    # the groups, their folds and every fit read it again, so the features are made once
    rows = cut_lineage(with_label(df, label, log).select(*features, "_label", F.col(group).alias("_group")))
    groups = shuffled_index(rows.select("_group").distinct(), [], ["_group"], 7, "_fold")
    folds = min(folds, groups.count())
    if folds < 2:
        raise ValueError("tuning needs two groups at least")
    # dealt out in turn, so that no fold is empty
    dealt = groups.select(F.col("_group").alias("_dealt"), F.pmod("_fold", F.lit(folds)).cast("int").alias("_fold"))
    train = rows.join(dealt, F.col("_group").eqNullSafe(F.col("_dealt")))
    train = cut_lineage(train.select(*features, "_label", "_fold"))
    pipe = make_pipeline(features, label, "rf")
    rf = pipe.getStages()[-1]
    grid = ParamGridBuilder().addGrid(rf.maxDepth, depths).addGrid(rf.numTrees, trees).build()
    judge = RegressionEvaluator(labelCol="_label", predictionCol="_pred", metricName="rmse")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=parallelism)
    m = cv.fit(train)
    rows = [(int(g[rf.maxDepth]), int(g[rf.numTrees]), float(s)) for g, s in zip(grid, m.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "max_depth int, num_trees int, rmse double"), m.bestModel
