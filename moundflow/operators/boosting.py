"""M3: gradient boosting round by round, with Spark ML's regression trees.

The rows carry a margin, the sum of the trees so far.  A round fits one tree to
the residuals of the fitted rows and looks at the loss of the held ones; every
``FOLD`` rounds the margin is written anew, so a plan holds so many trees at most.
Rounds are saved as they end: a fit that is interrupted goes on from there."""
from __future__ import annotations

import json

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundflow import constants as K
from moundflow.session import ensure_checkpoint_dir

#: Rounds whose trees are applied on the fly before the margin is written, with the
#: vectors: a tree's few comparisons a row are far less than growing one.
FOLD = 50


def ensemble(trees: list[DecisionTreeRegressionModel], weights: list[float]) -> GBTRegressionModel:
    """Spark's own boosted model of given trees."""
    sc = SparkSession.active().sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    array = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    numbers = gateway.new_array(jvm.double, len(trees))
    for i, (t, w) in enumerate(zip(trees, weights)):
        array[i], numbers[i] = t._java_obj, float(w)
    uid = f"gbtr_{trees[0].uid.rsplit('_', 1)[-1]}_{len(trees)}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, array, numbers))


class Rounds:
    """Trees, weights and holdout losses of the rounds so far, and the folder
    that has them (None: they are not saved)."""

    def __init__(self, folder: str | None = None):
        self.folder, self.trees, self.weights, self.losses = folder, [], [], []

    @classmethod
    def load(cls, spark: SparkSession, folder: str | None) -> "Rounds":
        """The rounds a folder has; a round whose saving was cut off does not count."""
        out = cls(folder)
        while folder is not None and _exists(spark, f"{folder}/round-{len(out.trees):05d}/done/_SUCCESS"):
            at = f"{folder}/round-{len(out.trees):05d}"
            weight, loss = json.loads(spark.read.text(f"{at}/done").first().value)
            out.trees.append(DecisionTreeRegressionModel.load(f"{at}/tree"))
            out.weights.append(weight)
            out.losses.append(loss)
        return out

    def add(self, spark: SparkSession, tree: DecisionTreeRegressionModel, weight: float, loss: float | None) -> None:
        if self.folder is not None:
            at = f"{self.folder}/round-{len(self.trees):05d}"
            tree.write().overwrite().save(f"{at}/tree")
            spark.createDataFrame([(json.dumps([weight, loss]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/done")
        self.trees.append(tree)
        self.weights.append(weight)
        self.losses.append(loss)

    def margin(self, df: DataFrame, since: int = 0) -> tuple[DataFrame, Column]:
        """The frame with ``_pred``, what the trees since a round give."""
        if since == len(self.trees):
            return df, F.lit(0.0)
        model = ensemble(self.trees[since:], self.weights[since:])
        return model.setPredictionCol("_pred").transform(df), F.col("_pred")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stop_round(losses, patience: int = K.GBT_PATIENCE) -> int | None:
    """The iteration count at which boosting stops: ``patience`` iterations in
    a row have not lowered the holdout loss; None while it goes on."""
    best, since = float("inf"), 0
    for i, loss in enumerate(losses):
        best, since = (loss, 0) if loss < best else (best, since + 1)
        if since >= patience:
            return i + 1
    return None


def boost(rows: DataFrame, label: str, held: str, max_iter: int, step: float, max_depth: int, seed: int,
          patience: int | None, folder: str | None = None, fold: int = FOLD) -> tuple[GBTRegressionModel, Rounds]:
    """Boost on ``features`` and the label of the rows that are not held, by
    squared error, until the rule of ``stop_round`` fires on the held rows' loss
    or ``max_iter`` rounds are done.  The first tree counts whole, later ones by
    ``step``; a later tree is fitted to twice the residual, the negative gradient.
    Every round is fitted once; the trees are those of ``GBTRegressor`` on the
    same rows, seed and layout."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rounds = Rounds.load(spark, folder)
    # a row's node is found anew at each level, which is cheaper than a table of them kept along
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="_target", maxDepth=max_depth, maxBins=64, seed=seed)
    base = rows.select("features", F.col(label).cast("double").alias("_label"), F.col(held).alias("_held"))
    written, at = base.withColumn("_margin", F.lit(0.0)), 0
    while len(rounds.trees) < max_iter and not (patience and stop_round(rounds.losses, patience)):
        if len(rounds.trees) - at >= fold:
            now, pred = rounds.margin(written, at)
            written = now.withColumn("_margin", F.col("_margin") + pred).select("features", "_label", "_held", "_margin").checkpoint(eager=True)
            at = len(rounds.trees)
        now, pred = rounds.margin(written, at)
        rest = F.col("_label") - F.col("_margin") - pred
        first = not rounds.trees
        fitted = tree.fit(now.where(~F.col("_held")).select("features", (rest if first else 2.0 * rest).alias("_target")))
        weight = 1.0 if first else step
        loss = None
        if patience:
            after = fitted.setPredictionCol("_tree").transform(now.where("_held"))
            loss = after.agg(F.avg((rest - weight * F.col("_tree")) ** 2)).first()[0]
        rounds.add(spark, fitted, weight, loss if loss is not None else float("inf") if patience else None)
    model = ensemble(rounds.trees, rounds.weights)
    model._set(labelCol=label)              # evaluateEachIteration reads it
    model._transfer_params_to_java()
    return model, rounds
