"""Time-ordered split, preprocessing + gradient-boosted
regression as one Spark ML ``Pipeline``, evaluation and ranking quality.

Scale notes: the split computes an exact global position without a
single-partition window over the rows (distributed zip-with-index over range
partitions, see ``time_ordinal``).  Metrics are one grouped pass; the split means they need
come from a 3-row aggregate joined back (broadcast, bounded by 3).
"""
from __future__ import annotations

import functools
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from moundflow import constants as K
from moundflow.operators.boosting import boost, stop_round  # noqa: F401
from moundflow.operators.features import ALL_FEATURES
from moundflow.operators.order_stats import exact_quantiles
from moundflow.session import ensure_checkpoint_dir, written

ORDER = ["game_date", "game_pk", "at_bat_number", "pitch_number"]


# W10 -----------------------------------------------------------------------
def _indexed(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows with their partition (``_pid``) and place in it (``_local``), where
    partitions follow each other in the order.

    Range-partitioned by the order (a date or game holding a large share of rows
    is split across partitions) and sorted inside each partition.  Range
    boundaries are sampled per execution, so the rows are written once."""
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)      # without a number it follows the data
    return written(dealt.sortWithinPartitions(*by)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordinal")


def time_ordinal(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Exact 0-based position of every row in (date, game, at-bat, pitch)
    order, plus the total row count ``_total``.

    Distributed zip-with-index: ``_indexed`` rows, rows per partition (one row per
    partition), prefix sums of those counts, plus each row's index inside its
    partition (the low 33 bits of ``monotonically_increasing_id``).  No window runs
    over the rows themselves, and the partition-count table is bounded by the
    number of partitions.  All columns move and are written: pass those that are
    read later.  Where only cuts in time are wanted, ``time_cuts`` moves the order
    alone.
    """
    o = _indexed(df, ORDER, partitions)
    counts = o.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid")          # one row per partition
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    j = o.join(F.broadcast(offsets), "_pid")      # bounded by the partition count
    return j.withColumn("time_rank", F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def time_cuts(df: DataFrame, positions) -> tuple[int, list[Column]]:
    """Rows of a written table, and for each of ``positions(rows)`` a condition that
    holds for exactly that many rows, the first in time (rows of equal time by
    ``_id``, unique).  Only the order is moved; of the rows at the cuts, one each,
    the driver learns the order, and the conditions compare with it."""
    order = [*ORDER, "_id"]
    o = _indexed(df.select(*order), order)
    counts = sorted(o.groupBy("_pid").count().collect())          # one row per partition
    total = sum(n for _, n in counts)
    at = {}
    for p in positions(total):
        rest = p
        for pid, n in counts:
            if rest < n:
                at[p] = (pid, rest)
                break
            rest -= n
    here = [(F.col("_pid") == pid) & (F.col("_local") == i) for pid, i in at.values()]
    found = {(r["_pid"], r["_local"]): r for r in o.where(functools.reduce(lambda a, b: a | b, here)).collect()} if here else {}

    def before(row) -> Column:
        out = F.lit(False)
        for c in reversed(order):           # nulls last
            less = F.col(c).isNotNull() if row[c] is None else F.coalesce(F.col(c) < F.lit(row[c]), F.lit(False))
            out = less | (F.col(c).eqNullSafe(F.lit(row[c])) & out)
        return out
    return total, [before(found[at[p]]) if p in at else F.lit(True) for p in positions(total)]


def time_split(df: DataFrame, train_frac: float = K.SPLIT_TRAIN, val_frac: float = K.SPLIT_VAL) -> DataFrame:
    """Label rows train / val / test at int(.70 n) and int(.85 n)."""
    return label_split(time_ordinal(df), train_frac, val_frac)


def label_split(o: DataFrame, train_frac: float = K.SPLIT_TRAIN, val_frac: float = K.SPLIT_VAL) -> DataFrame:
    cut1 = F.floor(F.col("_total") * F.lit(train_frac))
    cut2 = F.floor(F.col("_total") * F.lit(train_frac + val_frac))
    return o.withColumn("split", F.when(F.col("time_rank") < cut1, "train")
                        .when(F.col("time_rank") < cut2, "val").otherwise("test")).drop("_total")


def rolling_folds(df: DataFrame, n_folds: int = 5) -> DataFrame:
    """M9: fold id from the time ordinal — fold k trains on folds < k and
    validates on fold k (successive windows by date)."""
    o = time_ordinal(df)
    return o.withColumn("fold", F.least(F.floor(F.col("time_rank") * n_folds / F.col("_total")),
                                        F.lit(n_folds - 1)).cast("int")).drop("_total")


# M1 ------------------------------------------------------------------------
def column_types(df: DataFrame, feature_cols=ALL_FEATURES):
    """The feature columns of a table: (numeric, categorical), in the features'
    order.  Text and truth values are categorical."""
    kinds = {f.name: isinstance(f.dataType, (StringType, BooleanType)) for f in df.schema.fields}
    present = [c for c in feature_cols if c in kinds]
    return [c for c in present if not kinds[c]], [c for c in present if kinds[c]]


# M2 / M3 -------------------------------------------------------------------
def imputer(numeric: list[str], medians: dict[str, float | None]) -> SQLTransformer:
    """Nulls and NaN to exact medians (0 where a column has no value).  All columns are
    filled as one array: spelled out a column, the generated method is over 8,000
    bytes with the assembler's, and the JVM never compiles it."""
    values = ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in numeric)
    instead = ", ".join(f"{0.0 if medians[c] is None else medians[c]!r}D" for c in numeric)
    filled = f"transform(array({values}), (x, i) -> coalesce(nanvl(x, CAST(NULL AS DOUBLE)), array({instead})[i]))"
    return SQLTransformer(statement=f"SELECT *, {', '.join(f'_num_filled[{i}] AS `_imp_{c}`' for i, c in enumerate(numeric))} "
                                    f"FROM (SELECT *, {filled} AS _num_filled FROM __THIS__)")


def preprocessing(numeric: list[str], categorical: list[str], medians: dict[str, float | None]) -> list:
    """M2 stages: exact median impute + standardise numerics; one-hot
    categoricals with unseen levels mapped to all zeros; one ``features`` vector."""
    num_imp = [f"_imp_{c}" for c in numeric]
    idx = [f"_idx_{c}" for c in categorical]
    ohe = [f"_ohe_{c}" for c in categorical]
    stages = [
        imputer(numeric, medians),
        VectorAssembler(inputCols=num_imp, outputCol="_num_vec", handleInvalid="keep"),
        StandardScaler(inputCol="_num_vec", outputCol="_num_scaled", withMean=True, withStd=True),
    ]
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
            # dropLast drops the extra 'unseen' slot, so unseen -> all zeros
            OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"),
        ]
    stages.append(VectorAssembler(inputCols=["_num_scaled", *ohe], outputCol="features"))
    return stages


def fit_preprocessing(tr: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    medians = {c: v[0] for c, v in exact_quantiles(tr, numeric, [0.5]).items()}
    return Pipeline(stages=preprocessing(numeric, categorical, medians)).fit(tr)


def preprocessing_summary(pre: PipelineModel, tr: DataFrame) -> DataFrame:
    """What a fitted preprocessing holds: a row per column with its median, mean
    and deviation after imputing, or its levels."""
    numeric, categorical = model_columns(pre)
    scaler = pre.stages[2]
    medians = exact_quantiles(tr, numeric, [0.5])
    rows = [(c, "numeric", medians[c][0], float(m), float(s), None) for c, m, s in zip(numeric, scaler.mean, scaler.std)]
    if categorical:
        rows += [(c, "categorical", None, None, None, ",".join(x)) for c, x in zip(categorical, pre.stages[3].labelsArray)]
    return tr.sparkSession.createDataFrame(rows, "feature string, kind string, median double, mean double, std double, levels string")


def fit_boosted(tr: DataFrame, numeric: list[str], categorical: list[str], max_depth: int = K.GBT_MAX_DEPTH,
                step: float = K.GBT_STEP, max_iter: int = K.GBT_MAX_ITER, seed: int = K.GBT_SEED,
                patience: int | None = K.GBT_PATIENCE, label: str = "run_value", folder: str | None = None) -> PipelineModel:
    """M3: preprocessing, then boosting (``operators.boosting``) until
    ``patience`` iterations bring no lower loss on the holdout (``_es_holdout``
    rows), at most ``max_iter``.  The preprocessed rows are written once, as dense
    vectors, and read by every round; ``folder`` keeps the rounds, so that a fit can go on."""
    ensure_checkpoint_dir(tr.sparkSession)
    pre = fit_preprocessing(tr, numeric, categorical)
    keep = F.col("_es_holdout") if patience else F.lit(False)
    rows = dense(pre.transform(tr).select("features", label, keep.alias("_h"))).checkpoint(eager=True)
    if patience and rows.where("_h").isEmpty():
        patience = None
    gbt, _ = boost(rows, label, "_h", max_iter, step, max_depth, seed, patience, folder)
    return PipelineModel(stages=[*pre.stages, gbt.setFeaturesCol("features").setPredictionCol("prediction")])


def dense(rows: DataFrame, column: str = "features") -> DataFrame:
    """The same vectors, dense, with the column's attributes.  Trees look up values by
    their place, which a sparse vector searches for; written, equal rows of numbers
    are smaller than places and numbers, too."""
    kept = rows.schema[column].metadata
    return rows.withColumn(column, array_to_vector(vector_to_array(column)).alias(column, metadata=kept))


def layout_partitions(n: int) -> int:
    """Partitions of a training table, from its rows alone: a million rows each
    at scale, a few thousand at least.  Every level of a tree sends the statistics of
    all its nodes from each of them."""
    return max(-(-n // (1 << 20)), min(32, -(-n // 8192)), 1)


def prepare(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Categorical nulls -> 'missing'; booleans -> strings."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categorical})


def holdout_flag(df: DataFrame, fraction: float = K.GBT_VALIDATION_FRACTION, seed: int = K.GBT_SEED):
    """Deterministic 10 % early-stopping holdout (hash of the pitch key, so a
    retried task or a different partitioning gives the same rows)."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in ["game_pk", "at_bat_number", "pitch_number"]])
    return F.pmod(h, F.lit(1000)) < int(fraction * 1000)


def split_rows(features: DataFrame) -> tuple[DataFrame, list[str], list[str], int]:
    """The rows with a run value, written once and labelled train / val / test as
    ``time_split`` does; numeric and categorical columns; the number of rows."""
    numeric, categorical = column_types(features)
    df = written(prepare(features.filter(F.col("run_value").isNotNull()), categorical).withColumn("_id", F.monotonically_increasing_id()), "split")
    n, (train, val) = time_cuts(df, lambda n: [math.floor(n * K.SPLIT_TRAIN), math.floor(n * (K.SPLIT_TRAIN + K.SPLIT_VAL))])
    return df.withColumn("split", F.when(train, "train").when(val, "val").otherwise("test")).drop("_id"), numeric, categorical, n


def laid_out(df: DataFrame, n: int) -> DataFrame:
    """The trees' split sampling depends on how rows are spread over partitions:
    the ``n`` rows are laid out by a hash of the pitch key over a number of
    partitions that they give, sorted, and written once, so a fit is repeatable
    whatever came before."""
    key = ["game_pk", "at_bat_number", "pitch_number"]
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartition(layout_partitions(n), *key).sortWithinPartitions(*key).checkpoint(eager=True)


def split_table(features: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """The split rows as the trees read them; numeric and categorical columns."""
    df, numeric, categorical, n = split_rows(features)
    return laid_out(df, n), numeric, categorical


def train(features: DataFrame, max_iter: int = K.GBT_MAX_ITER, max_depth: int = K.GBT_MAX_DEPTH,
          early_stopping: bool = True, folder: str | None = None):
    """Fit on the train split; returns (model, numeric, categorical, split df)."""
    df, numeric, categorical = split_table(features)
    tr = df.filter(F.col("split") == "train")
    if early_stopping:
        tr = tr.withColumn("_es_holdout", holdout_flag(tr))
    model = fit_boosted(tr, numeric, categorical, max_iter=max_iter, max_depth=max_depth,
                        patience=K.GBT_PATIENCE if early_stopping else None, folder=folder)
    return model, numeric, categorical, df


# M8 ------------------------------------------------------------------------
def model_columns(model: PipelineModel) -> tuple[list[str], list[str]]:
    """The numeric and the categorical columns a fitted pipeline reads."""
    numeric = [c.removeprefix("_imp_") for c in model.stages[1].getInputCols()]
    categorical = list(model.stages[3].getInputCols()) if isinstance(model.stages[3], StringIndexerModel) else []
    return numeric, categorical


def model_inputs(model: PipelineModel) -> list[str]:
    """The feature columns a fitted pipeline reads (numeric, then categorical)."""
    numeric, categorical = model_columns(model)
    return numeric + categorical


def predict(model: PipelineModel, df: DataFrame, out: str = "predicted_rv", keep_vector: bool = False) -> DataFrame:
    """Score a table with the fitted pipeline; feature columns it lacks are
    filled with 0 (numeric) / '0' (categorical), as the published scorer
    does, then the prediction is renamed to ``out``.  ``keep_vector`` leaves
    the preprocessed ``features``."""
    numeric, categorical = model_columns(model)
    fill = {}
    for c in numeric:
        if c not in df.columns:
            fill[c] = F.lit(0.0)
        else:
            fill[c] = F.col(c).cast("double")
    for c in categorical:
        fill[c] = F.coalesce(F.col(c).cast("string"), F.lit("missing")) if c in df.columns else F.lit("0")
    keep = [c for c in df.columns if c not in fill and c != "prediction" and not c.startswith("_imp_")]
    scored = model.transform(df.select(*keep, *[v.alias(k) for k, v in fill.items()]))
    internal = [c for c in scored.columns if c.startswith(("_imp_", "_idx_", "_ohe_", "_num_"))] + ([] if keep_vector else ["features"])
    return scored.drop(*internal).withColumnRenamed("prediction", out)


# R6 over preprocessed candidates ----------------------------------------------
class LocationSlots:
    """Where the place of a pitch stands in a model's feature vector, and what
    each cell of a grid puts there: the pipeline is run once over the cells, so
    a candidate's vector is made for a cell by exchanging these slots."""

    def __init__(self, model: PipelineModel, spark, cells: list[dict], fixed: list[str], looked_up: list[str], levels: list[str]):
        numeric, categorical = model_columns(model)
        if numeric[-len(fixed) - len(looked_up):] != fixed + looked_up or categorical[-len(levels):] != levels:
            raise ValueError("the columns of a place are not the last of their kind")
        zeros = {c: 0.0 for c in numeric} | {c: "missing" for c in categorical}
        rows = [{**zeros, "_cell": i, **cell} for i, cell in enumerate(cells)] + [{**zeros, **{c: None for c in looked_up}, "_cell": len(cells)}]
        schema = ", ".join([*[f"`{c}` double" for c in numeric], *[f"`{c}` string" for c in categorical], "_cell int"])
        frame = spark.createDataFrame([tuple(r[c] for c in (*numeric, *categorical, "_cell")) for r in rows], schema)
        seen = PipelineModel(stages=model.stages[:-1]).transform(frame)
        vectors = [r.features.toArray().tolist() for r in seen.select("features", "_cell").orderBy("_cell").collect()]       # a row per cell
        widths = [seen.schema[f"_ohe_{c}"].metadata["ml_attr"]["num_attrs"] for c in levels]
        self.first, self.fixed = len(numeric) - len(fixed) - len(looked_up), len(fixed)
        self.after, self.last = len(numeric), len(vectors[0]) - sum(widths)
        self.numbers = [v[self.first:self.first + len(fixed)] for v in vectors[:-1]]
        self.levels = [v[self.last:] for v in vectors[:-1]]
        self.missing = vectors[-1][self.first + len(fixed):self.after]      # what the imputer gives
        scaler = model.stages[2]
        self.scale = [(float(scaler.mean[i]), 1.0 / float(scaler.std[i]) if scaler.std[i] else 0.0) for i in range(self.first + len(fixed), self.after)]

    def kept(self, base: Column) -> list[Column]:
        """What a cell leaves of a candidate's vector (an array): before and between
        its slots, as ``_head`` and ``_mid``."""
        return [F.slice(base, 1, self.first).alias("_head"), F.slice(base, self.after + 1, self.last - self.after).alias("_mid")]

    def vector(self, numbers: Column, levels: Column, looked_up: list[Column]) -> Column:
        """The candidate's vector with a cell's slots, from what ``kept`` left."""
        own = [F.coalesce((v - F.lit(m)) * F.lit(s), F.lit(d)) for v, (m, s), d in zip(looked_up, self.scale, self.missing)]
        return array_to_vector(F.concat(F.col("_head"), numbers, F.array(*own), F.col("_mid"), levels))


# A22 -----------------------------------------------------------------------
def regression_metrics(df: DataFrame, label: str = "run_value", pred: str = "prediction",
                       by: str = "split") -> DataFrame:
    """MSE, RMSE, MAE, R2 (and explained variance) per split in one pass;
    the split means come from a 3-row aggregate joined back."""
    means = df.groupBy(by).agg(F.avg(label).alias("_ybar"), F.avg(F.col(label) - F.col(pred)).alias("_ebar"))
    j = df.join(F.broadcast(means), by)
    err = F.col(label) - F.col(pred)
    g = j.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        F.sum((F.col(label) - F.col("_ybar")) * (F.col(label) - F.col("_ybar"))).alias("_sst"),
        F.sum((err - F.col("_ebar")) * (err - F.col("_ebar"))).alias("_sse_c"),
    )
    return g.select(by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                    (1 - F.col("_sse") / F.col("_sst")).alias("r2"),
                    (1 - F.col("_sse_c") / F.col("_sst")).alias("explained_variance"))


# A23 -----------------------------------------------------------------------
def ranking_quality(df: DataFrame, pred: str = "prediction", label: str = "run_value") -> DataFrame:
    """Per at-bat with at least 2 pitches: the actual run value of the pitch
    with the lowest prediction (first pitch wins ties) against the at-bat
    mean; share better and mean gain.  ``min_by`` is a partial aggregate."""
    ab = df.groupBy("game_pk", "at_bat_number").agg(
        F.min_by(F.col(label), F.struct(F.col(pred), F.col("pitch_number"))).alias("model_rv"),
        F.avg(label).alias("avg_rv"), F.count(F.lit(1)).alias("n"))
    ab = ab.filter(F.col("n") >= 2)
    return ab.agg(
        (F.avg((F.col("model_rv") < F.col("avg_rv")).cast("double")) * 100).alias("pct_better_than_avg"),
        F.avg(F.col("avg_rv") - F.col("model_rv")).alias("avg_rv_improvement"),
        F.count(F.lit(1)).alias("at_bats"))


# M6 ------------------------------------------------------------------------
def feature_importance(model: PipelineModel, scored: DataFrame, top: int = 30) -> DataFrame:
    """Importances of the fitted GBT with expanded one-hot names, top 30."""
    gbt = model.stages[-1]
    imp = gbt.featureImportances.toArray().tolist()
    meta = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for kind in meta.values():
        for a in kind:
            names[a["idx"]] = a["name"]
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    spark = scored.sparkSession
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.desc("importance"), F.asc("feature")).limit(top)


def shifted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have ``time_rank`` and ``_total``, with ``_s_<column>``: the value
    of the row a fixed way on in time, around the end.  That breaks a column's tie
    to its row and keeps its distribution; one join on the position serves all."""
    way = F.floor(F.col("_total") * 0.381966) + 1
    source = df.select(F.pmod(F.col("time_rank") - way, F.col("_total")).alias("time_rank"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    return df.join(source, "time_rank")


def permutation_importance(df: DataFrame, columns: list[str], predictor, label: str = "run_value") -> DataFrame:
    """M6: per column the mean squared error with it shifted in time, less that
    of the rows as they are.  ``df`` has ``time_rank`` from 0 and ``_total``;
    ``predictor`` maps a frame to one with ``prediction``."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = shifted(df, columns).checkpoint(eager=True)
    err = F.col(label) - F.col("prediction")

    def loss(d: DataFrame, name: str) -> DataFrame:
        return predictor(d).agg(F.avg(err * err).alias("mse")).select(F.lit(name).alias("feature"), "mse")
    base = loss(rows, "").select(F.col("mse").alias("mse_base"))
    out = None
    for c in columns:
        one = loss(rows.withColumn(c, F.col(f"_s_{c}")), c)
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(base)).select("feature", "mse_base", F.col("mse").alias("mse_shifted"), (F.col("mse") - F.col("mse_base")).alias("importance"))


def model_importance(model: PipelineModel, df: DataFrame, label: str = "run_value") -> DataFrame:
    """``permutation_importance`` of a fitted pipeline, for all its inputs in one
    pass: rows are preprocessed once, a feature's slots of the vector come from
    the row a fixed way on, and only the trees see the rows anew."""
    ensure_checkpoint_dir(df.sparkSession)
    numeric, categorical = model_columns(model)
    scored = predict(model, df, "prediction", keep_vector=True)
    seen = PipelineModel(stages=model.stages[:-1]).transform(df.limit(0).select(
        *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical]))
    slots, at = [], 0
    for c in [*numeric, *categorical]:
        width = 1 if c in numeric else seen.schema[f"_ohe_{c}"].metadata["ml_attr"]["num_attrs"]
        slots.append(F.struct(F.lit(c).alias("feature"), F.lit(at).alias("a"), F.lit(width).alias("n")))
        at += width
    rows = scored.select("time_rank", "_total", F.col(label).alias("_label"), "prediction", vector_to_array("features").alias("_v"))
    rows = shifted(rows, ["_v"]).checkpoint(eager=True)
    s = rows.select("_label", "prediction", "_v", "_s__v", F.explode(F.array(*slots)).alias("s"))
    v = F.concat(F.slice("_v", F.lit(1), F.col("s.a")), F.slice("_s__v", F.col("s.a") + 1, F.col("s.n")),
                 F.slice("_v", F.col("s.a") + F.col("s.n") + 1, F.lit(at) - F.col("s.a") - F.col("s.n")))
    s = model.stages[-1].transform(s.select("s.feature", "_label", F.col("prediction").alias("_own"), array_to_vector(v).alias("features")))
    err, own = F.col("_label") - F.col("prediction"), F.col("_label") - F.col("_own")
    g = s.groupBy("feature").agg(F.avg(own * own).alias("mse_base"), F.avg(err * err).alias("mse_shifted"))
    return g.withColumn("importance", F.col("mse_shifted") - F.col("mse_base"))


# M7 ------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# M4 ------------------------------------------------------------------------
def older_features(pitches: DataFrame) -> DataFrame:
    """The older trainer's inputs: situation, pitch, last pitch and the batter's
    record against the pitch type."""
    from moundflow.operators import analytics as AN
    df = AN.matchup_lookup(pitches, AN.matchup_stats(pitches)).withColumnRenamed("speed_delta", "last_pitch_speed_delta")
    return df.select("game_pk", "at_bat_number", "pitch_number", "run_value", *K.OLD_NUMERIC, *K.OLD_CATEGORICAL)


def train_random_split(features: DataFrame, max_iter: int = K.OLD_GBT_MAX_ITER, seed: int = K.GBT_SEED):
    """Older trainer: random 80/20 split (by a seeded hash of the pitch key, so
    a retried task keeps the same rows), median-imputed numerics, most-frequent
    imputed and one-hot encoded categoricals (levels unseen in training become
    zeros), depth 8, rate .06; returns (model, test RMSE DataFrame)."""
    df = features.filter(F.col("run_value").isNotNull())
    numeric = [c for c in K.OLD_NUMERIC if c in df.columns]
    categorical = [c for c in K.OLD_CATEGORICAL if c in df.columns]
    if missing := sorted({*K.OLD_NUMERIC, *K.OLD_CATEGORICAL} - set(df.columns)):
        raise ValueError(f"the older trainer needs {missing}")
    df = df.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.col(c).cast("string") for c in categorical})
    test = F.pmod(F.xxhash64(F.lit(seed), "game_pk", "at_bat_number", "pitch_number"), F.lit(5)) == 0
    tr, te = df.filter(~test), df.filter(test)
    # most frequent level per column (ties: the smallest), one row in all
    modes = {}
    for c in categorical:
        top = tr.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        modes[c] = top[0] if top else "missing"
    tr, te = (x.fillna(modes) for x in (tr, te))
    idx, ohe = [f"_idx_{c}" for c in categorical], [f"_ohe_{c}" for c in categorical]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"_imp_{c}" for c in numeric]),
              StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"),
              VectorAssembler(inputCols=[*[f"_imp_{c}" for c in numeric], *ohe], outputCol="features", handleInvalid="keep"),
              GBTRegressor(featuresCol="features", labelCol="run_value", maxDepth=8, stepSize=K.OLD_GBT_STEP,
                           maxIter=max_iter, seed=seed, maxBins=64)]
    model = Pipeline(stages=stages).fit(tr)
    err = model.transform(te).select(F.sqrt(F.avg((F.col("run_value") - F.col("prediction")) ** 2)).alias("rmse"))
    return model, err


# M9 ------------------------------------------------------------------------
def rolling_validation(features: DataFrame, n_folds: int = 5, max_iter: int = K.GBT_MAX_ITER,
                       max_depth: int = K.GBT_MAX_DEPTH, at_once: int = 4) -> DataFrame:
    """Successive time windows: for k = 1..n-1 fit on folds < k and score fold k;
    returns regression metrics per validation fold.  Fits are independent and
    leave slots idle between their small jobs, so ``at_once`` of them run from
    threads of their own, each in its scheduler pool, over one prepared table."""
    numeric, categorical = column_types(features)
    df = written(prepare(features.filter(F.col("run_value").isNotNull()), categorical).withColumn("_id", F.monotonically_increasing_id()), "folds")
    # a row's fold is the number of folds that end before it
    n, ends = time_cuts(df, lambda n: [-(-k * n // n_folds) for k in range(1, n_folds)])
    folded = laid_out(df.withColumn("fold", sum([(~e).cast("int") for e in ends], F.lit(0))).drop("_id"), n)
    sc = folded.sparkSession.sparkContext

    def one(k: int) -> list:
        sc.setLocalProperty("spark.scheduler.pool", f"fold-{k}")
        tr = folded.filter(F.col("fold") < k)
        tr = tr.withColumn("_es_holdout", holdout_flag(tr))
        model = fit_boosted(tr, numeric, categorical, max_iter=max_iter, max_depth=max_depth)
        scored = predict(model, folded.filter(F.col("fold") == k), "prediction").withColumn("split", F.lit(f"fold_{k}"))
        return regression_metrics(scored).collect()         # one row

    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for rs in pool.map(inheritable_thread_target(folded.sparkSession)(one), range(1, n_folds)) for r in rs]
    return folded.sparkSession.createDataFrame(rows, "split string, n long, mse double, rmse double, mae double, r2 double, explained_variance double")
