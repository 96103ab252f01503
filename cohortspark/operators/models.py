"""Classifiers by MLlib on wide features, and permutation importance over their predictions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.errors import IllegalArgumentException, PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import clip
from cohortspark.operators.evaluation import auprc
from cohortspark.operators.ordering import global_running
from cohortspark.sources.staging import checkpoints, pinned

#: Rows that a task of a boosted fit takes: a tree has a job a level, whose tasks cost more than the rows of a small one.
ROWS_A_TASK = 16_384


def design_matrix(blocks: list[DataFrame], cohort: DataFrame, drop: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """The blocks' columns joined on stay_id beside the cohort's rows, finite and within 10 000; and their names."""
    matrix = cohort
    names: list[str] = []
    for block in blocks:
        matrix = matrix.join(block, "stay_id", "left")
        names += [c for c in block.columns if c != "stay_id" and c not in drop]
    columns = [clip(F.col(c).cast("double"), -1e4, 1e4).alias(c) for c in names]
    return matrix.select(*cohort.columns, *columns), names


def logistic(names: list[str], n_train: int) -> Pipeline:
    """Median impute, standardise, balanced logistic regression with C = 0.5."""
    filled = [f"{c}__filled" for c in names]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=names, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            LogisticRegression(labelCol="label", weightCol="weight", regParam=1.0 / (0.5 * max(n_train, 1)), maxIter=100),
        ]
    )


def linear_margin(names: list[str], n_train: int) -> Pipeline:
    """Median impute, standardise, balanced linear support vectors: margins, no probabilities."""
    return Pipeline(stages=[*logistic(names, n_train).getStages()[:-1], LinearSVC(labelCol="label", weightCol="weight", regParam=0.01, maxIter=50)])


def boosted(names: list[str], rounds: int, sampling: float = 1.0, seed: int = 0) -> Pipeline:
    """Boosted trees of depth 6 on imputed values and missing flags."""
    filled = [f"{c}__filled" for c in names]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=names, outputCols=filled),
            VectorAssembler(inputCols=filled + [f"{c}__gap" for c in names], outputCol="features"),
            GBTClassifier(
                labelCol="label", weightCol="weight", maxDepth=6, maxIter=rounds, stepSize=0.05, minInstancesPerNode=20,
                subsamplingRate=sampling, featureSubsetStrategy=str(sampling) if sampling < 1 else "all", seed=seed,
            ),
        ]
    )


def with_weights(matrix: DataFrame, names: list[str]) -> DataFrame:
    """Balanced class weights by training counts, and flags of missing values."""
    n = {r["label"]: r["count"] for r in matrix.where("split = 'train'").groupBy("label").count().collect()}
    total = sum(n.values())
    weight = F.lit(1.0)
    for label, count in n.items():
        weight = F.when(F.col("label") == label, total / (len(n) * count)).otherwise(weight)
    return matrix.withColumns({"weight": weight} | {f"{c}__gap": F.col(c).isNull().cast("double") for c in names})


def fit(pipeline: Pipeline, matrix: DataFrame) -> PipelineModel:
    """The pipeline fitted on the training rows; boosted rounds cut their lineage in the shared folder every ten rounds."""
    checkpoints(matrix.sparkSession)
    return pipeline.fit(matrix.where("split = 'train'"))


def fit_all(pipelines: list[Pipeline], matrix: DataFrame) -> list[PipelineModel]:
    """Boosted pipelines fitted side by side, as the jobs of each come one after the other and leave cores free.

    The training rows are dealt by their number, whatever the cluster, and in order: sampling goes by tasks, so reruns agree.
    """
    train = pinned(matrix.where("split = 'train'"))
    tasks = max(1, -(-train.count() // ROWS_A_TASK))
    dealt = train.repartition(tasks, "stay_id").sortWithinPartitions("stay_id")
    checkpoints(matrix.sparkSession)
    with ThreadPool(len(pipelines)) as pool:
        return pool.map(lambda p: p.fit(dealt), pipelines)


def predict(model: PipelineModel, matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Keys, stay_id, split, y and prob; of a classifier without probabilities, its margin through the logistic function."""
    scored = model.transform(matrix)
    if "probability" in scored.columns:
        prob = vector_to_array("probability")[1]
    else:
        prob = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.select(*keys, "stay_id", "split", F.col("label").cast("int").alias("y"), prob.alias("prob"))


def sweep(runs: dict[str, Callable[[], Pipeline]], matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of every run (run, split, y, prob), and (run, error) of those that failed."""
    spark = matrix.sparkSession
    scored, failed = [], []
    for name, pipeline in runs.items():
        try:
            # Written here, so that a run that fails while it scores is a row too.
            scored.append(pinned(predict(fit(pipeline(), matrix), matrix).withColumn("run", F.lit(name))))
        except (ValueError, IllegalArgumentException, PySparkException) as error:
            failed.append((name, f"{type(error).__name__}: {str(error).splitlines()[0]}"[:200]))
    if not scored:
        raise ValueError(f"every run failed: {failed}")
    return reduce(lambda a, b: a.unionByName(b), scored), spark.createDataFrame(failed, "run string, error string")


def permutation_importance(
    model: PipelineModel, matrix: DataFrame, units: dict[str, list[str]], repeats: int = 20, seed: int = 0
) -> DataFrame:
    """feature, importance_mean and importance_sd: the drop of average precision when a unit's columns are dealt anew.

    units: the columns of each feature, moved together (one column, or all of a concept). matrix needs row_no (0..n-1).
    Each repeat has one permutation, the same for every unit; all repeats are numbered in one pass and all units scored
    as one table.
    """
    names = sorted({c for columns in units.values() for c in columns})
    n = matrix.count()
    dealt = matrix.select("row_no", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("repeat").cast("string"), F.col("row_no").cast("string")))
    dealt = dealt.withColumns({"o": order, "one": F.lit(1).cast("long")})
    ranked = global_running(dealt, [F.col("repeat"), F.col("o"), F.col("row_no")], {"to": "one"})
    moved = pinned(ranked.select("repeat", F.col("row_no").alias("source"), (F.col("to") - 1 - F.col("repeat") * n).alias("row_no")))
    values = matrix.select(F.col("row_no").alias("source"), F.struct(*names).alias("new"))
    rows = moved.join(values.hint("merge"), "source").join(matrix.hint("merge"), "row_no")
    rows = rows.withColumn("feature", F.explode(F.array(*map(F.lit, units))))
    replaced = {}
    for c in names:
        mine = F.col("feature").isin([u for u, columns in units.items() if c in columns])
        replaced[c] = F.when(mine, F.col(f"new.{c}")).otherwise(F.col(c))
        replaced[f"{c}__gap"] = replaced[c].isNull().cast("double")
    scored = predict(model, rows.withColumns(replaced), ["feature", "repeat"])
    runs = auprc(pinned(scored), ["feature", "repeat"])
    whole = auprc(predict(model, matrix), []).first()["auprc"]
    drop = F.lit(whole) - F.col("auprc")
    return runs.groupBy("feature").agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_sd"))
