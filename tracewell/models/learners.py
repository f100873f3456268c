"""Spark ML fits and scoring. The driver holds models and a few numbers, never rows."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    NGram,
    RegexTokenizer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import sigmoid
from tracewell.models.network import BlockPerceptron
from tracewell.operators.evaluate import (
    auc,
    auc_columns,
    confusion,
    recall_at_fpr,
    score_points,
    with_metrics,
)
from tracewell.operators.partition import exact_quantiles, unit_bucket
from tracewell.operators.splits import class_weight
from tracewell.session import materialize, shared_dir, written_table


# Training rows in one part of a fit.
PART_ROWS = 500_000


def with_weight(df: DataFrame, label: str = "label", cap: float | None = 11.0
                ) -> tuple[DataFrame, float]:
    """Add ``weight``: the class weight for positives, 1 for the rest."""
    w = float(class_weight(df, label, cap).first()["weight"])
    return df.withColumn("weight", F.when(F.col(label) == 1, w).otherwise(1.0)), w


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def gbt(trees: int = 200, depth: int = 4, rate: float = 0.1, seed: int = 0, subsample: float = 1.0,
        weighted: bool = True, validation: str | None = None) -> GBTClassifier:
    est = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth,
                        stepSize=rate, seed=seed, subsamplingRate=subsample, checkpointInterval=10)
    if weighted:
        est = est.setWeightCol("weight")
    if validation:
        est = est.setValidationIndicatorCol(validation)
    return est


def forest(trees: int = 100, depth: int = 8, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                                  numTrees=trees, maxDepth=depth, seed=seed)


def fit_tabular(train: DataFrame, features: list[str], learner) -> PipelineModel:
    """Weighted fit on a training table that is written once, so passes do not repeat its lineage."""
    shared_dir(train.sparkSession)
    rows, _ = with_weight(written_table(train.select(*features, "label"), "train"))
    return Pipeline(stages=[assembler(features), learner]).fit(small_parts(rows))


def small_parts(rows: DataFrame, most: int = PART_ROWS) -> DataFrame:
    """The rows in parts of about ``most`` at most: fits keep a part in memory as it was read."""
    parts = -(-rows.count() // most)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def score(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    """Add the positive-class probability; model columns are dropped."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*[c for c in df.columns if c != name], name)


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Feature importances, one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def top_importances(imp: DataFrame, k: int = 8) -> DataFrame:
    return imp.orderBy(F.desc("importance"), "feature").limit(k)


def metrics_row(scored: DataFrame) -> DataFrame:
    """Confusion metrics at 0.5 with ROC area and average precision.

    Scores are written first: the points read them twice, and a model would score the rows each time.
    """
    scored = written_table(scored.select("label", "prob"), "scores")
    at = F.col("threshold") >= 0.5
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return with_metrics(score_points(scored).agg(
        total("p", at).alias("tp"), total("n", at).alias("fp"), total("n", ~at).alias("tn"),
        total("p", ~at).alias("fn"), *[c.alias(n) for n, c in auc_columns().items()]))


# ---- standardisation and reconstruction error ----------------------------------------------

def fit_scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature, from one aggregation."""
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {f: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, f in enumerate(features)}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardised columns; anything undefined becomes 0."""
    z = {f: (F.col(f) - m) / (s if s else 1.0) for f, (m, s) in scaler.items()}
    return df.withColumns({f: F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)
                           for f, c in z.items()})


def fit_components(benign: DataFrame, features: list[str], k: int = 8):
    """Principal components of benign rows: a (features x k) matrix."""
    from pyspark.ml.feature import PCA
    vec = assembler(features).transform(benign)
    return PCA(k=min(k, len(features)), inputCol="features", outputCol="pc").fit(vec).pc.toArray()


def reconstruction_error(df: DataFrame, features: list[str], components) -> DataFrame:
    """Mean squared error after projecting onto the components, in Arrow batches."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    keep = [c for c in df.columns if c not in features]
    schema = StructType([df.schema[c] for c in keep] + [StructField("mse", DoubleType())])

    def run(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            gap = x - (x @ components) @ components.T
            out = pdf[keep].copy()
            out["mse"] = (gap ** 2).mean(axis=1)
            yield out

    return df.mapInPandas(run, schema)


def error_threshold(errors: DataFrame, q: float = 0.95) -> float:
    """Exact quantile of the errors; x/(1+x) gives bounded, order-keeping buckets."""
    bucket = unit_bucket(F.col("mse") / (1 + F.col("mse")))
    return float(exact_quantiles(errors, "mse", {"t": q}, bucket).first()["t"])


def anomaly_scores(errors: DataFrame, threshold: float) -> DataFrame:
    return errors.withColumns({"ae_score": F.col("mse") / threshold,
                               "ae_pred": (F.col("mse") > threshold).cast("int")})


# ---- calibration and fusion ----------------------------------------------------------------

def fit_platt(df: DataFrame, score_col: str, label: str = "label") -> tuple[float, float]:
    """(coefficient, intercept) of the unit-penalty logistic fit.

    Rows are counted per distinct score first, and the fit runs on the weighted counts.
    """
    counted = materialize(df.groupBy(score_col, label).agg(F.count(F.lit(1)).alias("weight")))
    n = counted.agg(F.sum("weight")).first()[0]
    vec = VectorAssembler(inputCols=[score_col], outputCol="features").transform(
        counted.withColumn("weight", F.col("weight").cast("double")))
    fit = LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / n,
                             elasticNetParam=0.0, standardization=False, maxIter=200,
                             tol=1e-10).fit(vec)
    return float(fit.coefficients[0]), float(fit.intercept)


def fit_platt_by(df: DataFrame, key: str, names: list[str], score_col: str = "prob") -> DataFrame:
    """One calibrator per named component."""
    rows = [(n, *fit_platt(df.where(F.col(key) == n), score_col)) for n in names]
    return df.sparkSession.createDataFrame(rows, f"{key} string, coef double, intercept double")


def platt(x, coef: float, intercept: float):
    return sigmoid(F.lit(coef) * x + F.lit(intercept))


def fuse(a, b, weight: float = 0.7) -> dict:
    """Fusion strategies over two calibrated scores."""
    return {"single_a": a, "single_b": b, "mean": (a + b) / 2, "max": F.greatest(a, b),
            "weighted": weight * a + (1 - weight) * b}


def strategies_long(df: DataFrame, columns: dict, keep: list[str]) -> DataFrame:
    """One row per input row and strategy, for grouped evaluation."""
    items = [F.struct(F.lit(n).alias("strategy"), c.alias("prob")) for n, c in columns.items()]
    return df.select(*keep, F.explode(F.array(*items)).alias("_s")).select(*keep, "_s.*")


def weight_sweep(df: DataFrame, a: str, b: str, weights: list[float], target: float = 0.01
                 ) -> DataFrame:
    """recall at the FPR target and ROC area per weight, all curves in one job."""
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("w")
    rows = df.select("label", a, b, w).select(
        "w", "label", (F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b)).alias("prob"))
    pts = materialize(score_points(rows, keys=["w"]))
    return recall_at_fpr(pts, target, ["w"]).join(auc(pts, ["w"]), "w")


# ---- token, text and packet classifiers ----------------------------------------------------

def token_pipeline(column: str = "tokens", buckets: int = 4096) -> Pipeline:
    """Tokens and their pairs, hashed, into a logistic model."""
    return Pipeline(stages=[
        NGram(n=2, inputCol=column, outputCol="pairs"),
        HashingTF(inputCol=column, outputCol="f1", numFeatures=buckets),
        HashingTF(inputCol="pairs", outputCol="f2", numFeatures=buckets),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
        LogisticRegression(labelCol="label", weightCol="weight", regParam=0.01, maxIter=30)])


def text_pipeline(column: str = "text", buckets: int = 1 << 16) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=column, outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=buckets),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="label", weightCol="weight", regParam=0.01, maxIter=30)])


def packet_mlp(features: list[str], hidden: tuple[int, ...] = (64, 32), iters: int = 50,
               seed: int = 0) -> BlockPerceptron:
    return BlockPerceptron([len(features), *hidden, 2], iters, seed)


def balance_copies(df: DataFrame, label: str = "label") -> DataFrame:
    """Repeat the smaller class until both weigh the same, by whole copies."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
                 ).first()
    small, times = (1, row["n"] / max(row["p"], 1)) if row["p"] < row["n"] else (
        0, row["p"] / max(row["n"], 1))
    copies = F.when(F.col(label) == small, max(1, math.floor(times))).otherwise(1)
    return df.withColumn("_c", F.explode(F.sequence(F.lit(1), copies))).drop("_c")


def source_probe(df: DataFrame, features: list[str], folds: int = 5, trees: int = 20,
                 seed: int = 0) -> float:
    """Cross-validated accuracy of telling two data sources apart."""
    rows = materialize(assembler(features).transform(df.select(*features, "label")).select(
        "features", "label"))
    learner = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees,
                                     maxDepth=5, seed=seed)
    cv = CrossValidator(
        estimator=learner, estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, seed=seed,
        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"))
    return float(cv.fit(rows).avgMetrics[0])


def select_model(train: DataFrame, new: DataFrame, old: DataFrame, features: list[str],
                 candidates: list, forget: float = 0.02) -> list[dict]:
    """Detection minus FPR on the new domain, subject to the old domain's F1 not dropping.

    Returns one row per candidate; ``selected`` marks the best that passes the guard.
    """
    rows, best_old = [], None
    train = written_table(train.select(*features, "label"), "train")
    for name, learner in candidates:
        model = fit_tabular(train, features, learner)
        at_new = confusion(score(model, new)).first()
        at_old = confusion(score(model, old)).first()
        best_old = at_old["f1"] if best_old is None else best_old
        rows.append({"candidate": name, "detection": at_new["recall"], "fpr": at_new["fpr"],
                     "old_f1": at_old["f1"], "gain": at_new["recall"] - at_new["fpr"],
                     "passes": at_old["f1"] >= best_old - forget})
    top = max((r["gain"] for r in rows if r["passes"]), default=None)
    for r in rows:
        r["selected"] = r["passes"] and r["gain"] == top
    return rows


def ablation(train: DataFrame, test: DataFrame, variants: dict[str, list[str]], make_learner
             ) -> DataFrame:
    """Metrics per feature subset and the F1 change against ``full``."""
    rows = []
    for name, feats in variants.items():
        m = metrics_row(score(fit_tabular(train, feats, make_learner()), test)).first()
        rows.append((name, len(feats), m["f1"], m["recall"], m["fpr"], m["roc_auc"]))
    base = next(r[2] for r in rows if r[0] == "full")
    return train.sparkSession.createDataFrame(
        [(*r, r[2] - base) for r in rows],
        "variant string, n_features int, f1 double, recall double, fpr double, roc_auc double, "
        "f1_delta double")


def save_artifact(model: PipelineModel, path: str, config: dict, spark) -> None:
    """Model plus its configuration as one JSON row."""
    import json
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/config")


def load_artifact(path: str, spark) -> tuple[PipelineModel, dict]:
    import json
    return (PipelineModel.load(f"{path}/model"),
            json.loads(spark.read.text(f"{path}/config").first()[0]))


def rescoring_gap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Largest difference between two scorings of the same rows."""
    both = a.select(key, F.col("prob").alias("_a")).join(
        b.select(key, F.col("prob").alias("_b")), key)
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_gap"))

