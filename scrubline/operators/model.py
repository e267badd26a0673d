"""Model training: random forest with automatic target and problem type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import col, is_numeric
from .rows import split_frames

# --- fixed values ------------------------------------------------------------
TARGET_WORDS = [
    "target", "label", "class", "output", "result", "churn", "default", "fraud", "status", "outcome",
    "price", "salary", "revenue", "score",
]
# --- end of fixed values -----------------------------------------------------


def detect_target(df: DataFrame) -> str:
    """First column that holds the strongest target word, else the last one."""
    matches = [name for word in TARGET_WORDS for name in df.columns if word in name.lower()]
    return matches[0] if matches else df.columns[-1]


def train_model(df: DataFrame, target: str | None = None, trees: int = 100, test_size: float = 0.2, seed: int = 42,
                keys=None, max_bins_limit: int = 10_000) -> dict:
    """Fit a forest and evaluate it on held-out rows.

    Returns ``model``, ``problem``, ``metrics``, ``importance`` (a DataFrame of
    the 15 most important features) and ``skipped`` (feature -> why it was left
    out).  Text features are index-encoded.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    target = target or detect_target(df)
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    data = df.where(col(target).isNotNull())
    names = [f.name for f in df.schema if f.name != target and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))]
    stats = data.agg(F.approx_count_distinct(col(target)).alias("_t"), F.count("*").alias("_n"),
                     *[F.count(col(c)).alias(f"f{i}") for i, c in enumerate(names)],
                     *[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
    regression = is_numeric(df, target) and stats["_t"] > 10
    skipped = {c: "half of its values or more are null" for i, c in enumerate(names) if stats[f"f{i}"] <= 0.5 * stats["_n"]}
    skipped |= {c: f"text with over {max_bins_limit} values" for i, c in enumerate(names) if c not in skipped and not is_numeric(df, c) and stats[f"d{i}"] > max_bins_limit}
    distinct = {c: stats[f"d{i}"] for i, c in enumerate(names)}
    names = [c for c in names if c not in skipped]
    texts = [c for c in names if not is_numeric(df, c)]
    numbers = [c for c in names if is_numeric(df, c)]
    data = data.select(col(target), *[col(c).cast("string").alias(c) for c in texts], *[col(c).cast("double").alias(c) for c in numbers])
    stages = []
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=[f"_i_{c}" for c in texts], handleInvalid="keep", stringOrderType="alphabetAsc"))
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"_n_{c}" for c in numbers], strategy="median"))
    features = [f"_i_{c}" for c in texts] + [f"_n_{c}" for c in numbers]
    stages.append(VectorAssembler(inputCols=features, outputCol="_features"))
    bins = max([32] + [int(distinct.get(c, 0) * 1.2) + 2 for c in texts])
    forest = dict(featuresCol="_features", labelCol="_label", numTrees=trees, seed=seed, maxBins=bins)
    if regression:
        data = data.withColumn("_label", col(target).cast("double"))
        stages.append(RandomForestRegressor(**forest))
    else:
        stages.insert(0, StringIndexer(inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc"))
        data = data.withColumn("_target", col(target).cast("string"))
        stages.append(RandomForestClassifier(**forest))
    train, test = split_frames(data, test_size, seed, keys or [target, *texts, *numbers])
    model = Pipeline(stages=stages).fit(train)
    scored = model.transform(test)
    if regression:
        metrics = {m: RegressionEvaluator(labelCol="_label", metricName=m).evaluate(scored) for m in ("mae", "r2", "rmse")}
    else:
        metrics = {m: MulticlassClassificationEvaluator(labelCol="_label", metricName=m).evaluate(scored)
                   for m in ("accuracy", "f1", "weightedPrecision", "weightedRecall")}
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(texts + numbers, map(float, weights)), key=lambda x: (-x[1], x[0]))[:15]
    importance = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return {"model": model, "problem": "regression" if regression else "classification", "target": target,
            "metrics": metrics, "importance": importance, "skipped": skipped}
