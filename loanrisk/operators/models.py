"""Model training, scoring and the run log.

Data stays in the executors: WoE transform, assembling, scaling and
scoring are narrow stages; optimiser iterations are Spark jobs that
tree-aggregate gradients. Only bins, coefficients, knots, metrics and run-log
rows reach the driver.

* ``train_scorecard`` - WoE bins + IV selection, class-weighted L2 logistic
  regression (C = 1 -> regParam = 1 / sum(weights)), isotonic calibration of
  the margin on the calibration split, integer points.
* ``train_boosted_trees`` - GBTClassifier's rules (fitted by ``trees.py``) with positive-class weight,
  sentinel + indicator for missing values, isotonic calibration.
* ``train_neural_net`` - standard scaling (train only), fill 0, oversampled
  positives (a row counts as its copies, ``perceptron.py``), 128-64-32 perceptron.
* ``Scorer`` - what training leaves: scores any frame with the model's
  features, and is saved and loaded whole, calibrator included.
* ``RunLog`` - params / tags / metrics as a long table; promotion rule.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanrisk.functions.num import dround, integer_points, log_odds_to_points
from loanrisk.operators import metrics, perceptron, split, trees, woe
from loanrisk.operators.calibration import Knots, isotonic
from loanrisk.sources.io import publish, version_path, write_csv

# --- fixed values -----------------------------------------------------------
# Challenger features (origination, flags, months 1-6 behaviour).
CHALLENGER_FEATURES = [
    "loan_amnt", "int_rate", "term_months", "installment",
    "annual_inc", "dti", "revol_util", "revol_bal",
    "delinq_2yrs", "open_acc", "pub_rec", "total_acc",
    "emp_length_years", "loan_to_income", "payment_to_income",
    "grade_numeric", "home_ownership_enc",
    "high_dti_flag", "high_util_flag", "dual_stress_flag",
    "prior_delinq_flag", "public_record_flag",
    "avg_payment_ratio_m6", "min_payment_ratio_m6",
    "payment_volatility_m6", "active_months_m6",
    "payment_trend_m6", "first_month_ratio",
    "last_month_ratio", "avg_monthly_change",
    "underpayment_flag", "missed_payment_flag",
    "deteriorating_flag", "early_dropout_flag",
]
GBT_PARAMS = dict(maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.8,
                  featureSubsetStrategy="0.8", seed=42)
# Execution only (same trees): checkpoint the rows' margins every 10 trees into the
# shared checkpoint folder, so that 300 iterations do not build one long lineage that
# a lost executor must replay. A row's node is found again at each level.
GBT_EXECUTION = dict(cacheNodeIds=False, checkpointInterval=10)
# A fit makes hundreds of short passes, and each costs time per task: partitions hold
# at least the first number of rows, up to FIT_SPREAD of them, and at most the second.
FIT_ROWS = (32_768, 524_288)
FIT_SPREAD = 24
MLP_HIDDEN = [128, 64, 32]
MLP_EPOCHS = 50
MLP_BATCH = 256
PROMOTION_MARGIN = 0.02     # challenger must beat champion Gini by more than this
IMPORTANCE_TOP = 15
MISSING_SENTINEL = -999.0
# ---------------------------------------------------------------------------

LABEL = "default_flag"


# ---------------------------------------------------------------- run log

LOG_KEY = ["run_id", "kind", "key"]
LOG_SCHEMA = "run_id string, run string, at double, kind string, key string, value string"


@dataclass
class RunLog:
    """(run id, run, time, kind, key, value) rows; kinds: param, tag, metric.

    A run name may be used again: ``start`` gives each run an id and a time, and
    what reads the log takes the latest run of a name."""
    rows: list[tuple[str, str, float, str, str, str]] = field(default_factory=list)
    current: dict[str, tuple[str, float]] = field(default_factory=dict)

    def start(self, run: str, at: float | None = None) -> None:
        self.current[run] = (uuid.uuid4().hex, time.time() if at is None else at)

    def log(self, run: str, kind: str, key: str, value) -> None:
        if run not in self.current:
            self.start(run)
        run_id, at = self.current[run]
        self.rows.append((run_id, run, at, kind, key, str(value)))

    def tags(self, run: str, d: dict) -> None:
        for k, v in d.items():
            self.log(run, "tag", k, v)

    def params(self, run: str, d: dict) -> None:
        for k, v in d.items():
            self.log(run, "param", k, v)

    def metrics(self, run: str, d: dict) -> None:
        for k, v in d.items():
            if v is not None:
                self.log(run, "metric", k, v)

    def metric(self, run: str, key: str) -> float | None:
        """The metric's value in the latest run of that name."""
        run_id = self.current.get(run, ("", 0.0))[0]
        for r in reversed(self.rows):
            if r[0] == run_id and r[3:5] == ("metric", key):
                return float(r[5])
        return None

    def champion(self) -> str | None:
        """The run tagged champion last."""
        tagged = [r for r in self.rows if r[3:] == ("tag", "champion", "true")]
        return max(tagged, key=lambda r: r[2])[1] if tagged else None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, LOG_SCHEMA)

    def append_to(self, spark: SparkSession, path: str) -> None:
        """Add the rows that the log table at ``path`` (shared storage) does not hold
        yet, by run id, kind and key: appending again changes nothing."""
        mine = self.frame(spark).dropDuplicates(LOG_KEY)
        try:
            held = read_log(spark, path).select(*LOG_KEY)
            mine = mine.join(held, LOG_KEY, "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        mine.coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """Rows of the latest run of each name."""
    last = log.groupBy("run").agg(F.max(F.struct("at", "run_id")).alias("_last"))
    return (log.join(last, "run").where((F.col("at") == F.col("_last.at")) & (F.col("run_id") == F.col("_last.run_id")))
            .drop("_last"))


def _run_gini(log: DataFrame) -> DataFrame:
    """One row per run name (its latest run): metrics pivoted, champion flag,
    champion's Gini.

    The run log holds a handful of rows per run, so the champion's Gini is
    spread with a window over that small frame (no join needed).
    """
    log = latest_runs(log)
    m = (log.where(F.col("kind") == "metric")
         .groupBy("run").pivot("key", ["gini", "ks", "auc", "calibration_error"])
         .agg(F.first(F.col("value").cast("double"))))
    tagged = F.when((F.col("kind") == "tag") & (F.col("key") == "champion") & (F.col("value") == "true"), F.struct("at", "run_id"))
    champ = log.groupBy("run").agg(F.max(tagged).alias("_tagged"))
    every = Window.partitionBy()
    # of several runs tagged champion the latest is it: its name and its Gini
    g = m.join(champ, "run", "left").withColumn("is_champion", F.coalesce(F.col("_tagged") == F.max("_tagged").over(every), F.lit(False)))
    return g.withColumns({
        "champion": F.max(F.when(F.col("is_champion"), F.col("run"))).over(every),
        "champion_gini": F.max(F.when(F.col("is_champion"), F.col("gini"))).over(every),
    }).drop("_tagged")


def promotion(log: DataFrame, margin: float = PROMOTION_MARGIN) -> DataFrame:
    """Challenger Gini > champion Gini + margin (strict); champion read from the log."""
    g = _run_gini(log).where(~F.col("is_champion") & F.col("gini").isNotNull())
    return g.select(F.col("run").alias("challenger"), F.col("gini").alias("challenger_gini"),
                    "champion", "champion_gini",
                    (F.col("champion_gini") + F.lit(margin)).alias("threshold"),
                    (F.col("gini") > F.col("champion_gini") + F.lit(margin)).alias("promotion_eligible"),
                    dround(F.col("gini") - F.col("champion_gini"), 4).alias("delta"))


def comparison(log: DataFrame) -> DataFrame:
    """One row per run: gini, ks, auc, calibration error, delta vs champion."""
    g = _run_gini(log)
    return (g.select("run", "is_champion", "gini", "ks", "auc", "calibration_error",
                     dround(F.col("gini") - F.col("champion_gini"), 4).alias("delta_vs_champion"))
            .orderBy(F.desc("gini"), "run"))


# ---------------------------------------------------------------- helpers

def prob_of(col: str = "_probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def splits(mf: DataFrame, cuts: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, calibration and test rows of the mature vintages; ``cuts``: class cuts
    that were found before."""
    d = split.with_split(split.mature(mf), cuts)
    return (d.where(F.col("split") == "train"), d.where(F.col("split") == "cal"),
            d.where(F.col("split") == "test"))


def present_features(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted features that exist."""
    have = set(df.columns)
    return [f for f in wanted if f in have]


@dataclass
class Scorer:
    """A fitted model that scores any frame with its features.

    ``kind`` scorecard: bins, coefficients and intercept, a plain column
    expression (a feature without bins stands for its WoE). ``boosted_trees`` and ``neural_net``: a fitted pipeline. All carry
    the calibration knots, a table. ``score`` adds ``p`` and, for the scorecard,
    ``margin`` and ``points``; it moves no rows while the knots' ranges can be
    broadcast."""
    kind: str
    features: list[str]
    knots: Knots | None = None
    bins: dict[str, woe.FeatureBins] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0
    with_nulls: list[str] = field(default_factory=list)
    pipeline: PipelineModel | None = None

    def raw(self, df: DataFrame) -> DataFrame:
        """``df`` with the uncalibrated score ``_raw``."""
        if self.kind == "scorecard":
            margin = F.lit(self.intercept)
            for f, c in zip(self.features, self.coefficients):
                margin = margin + F.lit(c) * (woe.woe_column(self.bins[f]) if f in self.bins else F.col(f))
            return df.withColumn("_raw", margin)
        prepared = df.withColumns(prepared_columns(self.kind, self.features, self.with_nulls))
        return self.pipeline.transform(prepared).select(*df.columns, prob_of().alias("_raw"))

    def on_inputs(self, df: DataFrame) -> tuple["Scorer", DataFrame]:
        """The same raw score over ``df`` with the features as the sum takes them: a
        scorecard without bins, and the WoE in place of the values. A pipeline takes the
        values themselves."""
        if self.kind != "scorecard":
            return self, df
        return (Scorer(self.kind, self.features, None, {}, self.coefficients, self.intercept),
                df.withColumns({f: woe.woe_column(self.bins[f]) for f in self.features}))

    def with_inputs(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with ``out``, the array that a pipeline's stages after the first see."""
        return df.withColumn(out, F.array(*prepared_columns(self.kind, self.features, self.with_nulls).values()))

    def raw_replaced(self, df: DataFrame, inputs: str, feature: str, value: str) -> DataFrame:
        """A pipeline's ``_raw`` over ``with_inputs``' arrays, with the value of the feature that a
        row names in place of its own: all rows by one short expression, whatever the features."""
        at = F.array_position(F.array(*map(F.lit, self.features)), F.col(feature)) - 1
        columns = list(prepared_columns(self.kind, self.features, self.with_nulls))
        flags = F.array(*[F.lit(c.removeprefix("_f_")) for c in columns[len(self.features):]], F.lit(""))
        flag = F.array_position(flags, F.concat(F.col(feature), F.lit("_missing"))) - 1 + len(self.features)
        fill = F.lit(MISSING_SENTINEL if self.kind == "boosted_trees" else 0.0)
        df = df.withColumns({"_at": at, "_flag": F.when(flag >= len(self.features), flag).otherwise(-1),
                             "_value": F.coalesce(F.col(value), fill), "_null": F.col(value).isNull().cast("double")})
        new = F.transform(inputs, lambda v, i: F.when(i == F.col("_at"), F.col("_value")).when(i == F.col("_flag"), F.col("_null")).otherwise(v))
        assembler, *rest = self.pipeline.stages
        out = PipelineModel(stages=rest).transform(df.withColumn(assembler.getOutputCol(), array_to_vector(F.when(F.col("_at") < 0, F.col(inputs)).otherwise(new))))
        return out.withColumn("_raw", prob_of())

    def score(self, df: DataFrame) -> DataFrame:
        out = self.knots.apply(self.raw(df), "_raw", "p")
        if self.kind == "scorecard":
            out = out.withColumns({"margin": F.col("_raw"), "points": integer_points(log_odds_to_points("_raw"))})
        return out.drop("_raw")

    def save(self, spark: SparkSession, path: str) -> str:
        """A fresh version of the model at ``path``, published when all of it is
        written; earlier versions stay. Returns the version's name."""
        return publish(spark, path, lambda where: self._write(spark, where))

    def _write(self, spark: SparkSession, path: str) -> None:
        """Everything under ``path`` on shared storage: ``spec``, the ``knots`` and,
        where there is one, ``pipeline``; the bins also as a table."""
        spec = {"kind": self.kind, "features": self.features,
                "bins": woe.to_spec(self.bins), "coefficients": self.coefficients, "intercept": self.intercept,
                "with_nulls": self.with_nulls}
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.knots.table.write.mode("overwrite").parquet(f"{path}/knots")
        if self.bins:
            woe.bin_table(spark, self.bins).write.mode("overwrite").parquet(f"{path}/bins")
        spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")

    @staticmethod
    def load(spark: SparkSession, path: str, version: str | None = None) -> "Scorer":
        """The model at ``path``: a named version, or the latest that is complete."""
        path = version_path(spark, path, version)
        spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
        pipeline = None if spec["kind"] == "scorecard" else PipelineModel.load(f"{path}/pipeline")
        knots = Knots(spark.read.parquet(f"{path}/knots"))
        return Scorer(spec["kind"], spec["features"], knots, woe.from_spec(spec["bins"]),
                      spec["coefficients"], spec["intercept"], spec["with_nulls"], pipeline)


def prepared_columns(kind: str, features: list[str], with_nulls: list[str]) -> dict[str, F.Column]:
    """The model's input columns, under names of their own: boosted trees get a
    sentinel for nulls and an indicator for features that had them in training;
    the perceptron gets 0 (P12)."""
    fill = MISSING_SENTINEL if kind == "boosted_trees" else 0.0
    cols = {f"_f_{f}": F.coalesce(F.col(f).cast("double"), F.lit(fill)) for f in features}
    if kind == "boosted_trees":
        cols |= {f"_f_{f}_missing": F.col(f).isNull().cast("double") for f in with_nulls}
    return cols


@dataclass
class Trained:
    name: str
    metrics: dict
    scored: DataFrame          # loan_id, y, p, annual_inc (test split)
    scorer: Scorer
    extra: dict = field(default_factory=dict)


def _finish(run: str, scorer: Scorer, test: DataFrame, log: RunLog | None, artifacts: str | None,
            params: dict, tags: dict, more: dict, extra: dict, sizes: tuple[int, int]) -> Trained:
    """Evaluate on the hold-out, log the run (S12), write the artifacts."""
    spark = test.sparkSession
    more_cols = [c for c in ("margin", "points") if scorer.kind == "scorecard"]
    scored = scorer.score(test).select("loan_id", F.col(LABEL).alias("y"), "p", "annual_inc", *more_cols)
    m = metrics.evaluate(scored).first().asDict()
    out = Trained(run, m, scored, scorer, extra)
    if artifacts:
        scorer.save(spark, f"{artifacts}/model")
        if "iv_summary" in extra:
            write_csv(extra["iv_summary"], f"{artifacts}/iv_summary")
    if log is not None:
        champion, champion_gini = log.champion(), None
        log.start(run)
        log.tags(run, tags)
        log.params(run, {**params, "train_vintages": f"<={split.MATURE_LAST_YEAR}"})
        log.metrics(run, {**m, **more, "train_size": sizes[0], "test_size": sizes[1]})
        if artifacts:
            log.log(run, "tag", "artifacts", artifacts)
        if tags.get("champion") != "true":
            champion_gini = log.metric(champion, "gini") if champion else None
            log.metrics(run, {"gini_overall": m["gini"], **{r["metric_name"]: r["gini"] for r in
                                                            metrics.income_band_gini(scored).collect()}})
            if champion_gini is not None and m["gini"] is not None:
                threshold = champion_gini + PROMOTION_MARGIN
                log.metrics(run, {"champion_gini": champion_gini, "promotion_threshold": threshold})
                log.log(run, "tag", "promotion_eligible", str(m["gini"] > threshold).lower())
    return out


def fit_partitions(rows: int) -> int:
    """Partitions of a frame that a fit passes over many times: by its rows alone, so
    that a fit is the same on any cluster, and whatever the tables' buckets are."""
    least, most = FIT_ROWS
    return max(1, min(-(-rows // least), FIT_SPREAD), -(-rows // most))


def spread(df: DataFrame, rows: int, key: str = "loan_id") -> DataFrame:
    """``df`` dealt by its key to ``fit_partitions`` partitions, in the key's order."""
    return df.repartition(fit_partitions(rows), key).sortWithinPartitions(key)


def _class_rows(train: DataFrame) -> dict[int, dict]:
    """Rows and weights per class, from one small aggregate."""
    return {r[LABEL]: r.asDict() for r in split.class_weights(train).collect()}


def _weight_column(classes: dict[int, dict], key: str) -> F.Column:
    out = F.lit(1.0)
    for c, r in classes.items():
        out = F.when(F.col(LABEL) == c, F.lit(float(r[key]))).otherwise(out)
    return out


# ---------------------------------------------------------------- scorecard

def train_scorecard(mf: DataFrame, features: list[str], min_iv: float = woe.MIN_IV,
                    log: RunLog | None = None, run: str = "scorecard_v1",
                    fitted: dict | None = None, artifacts: str | None = None, cuts: dict | None = None) -> Trained:
    """M1-M5, M7-M11, M16 on the mature vintages (``fitted``: bins already fit
    on the same training split). With ``artifacts`` (a shared folder), the IV
    summary is written as CSV (S11) and the scorer is saved (S13). Raises if no
    feature reaches ``min_iv``."""
    spark = mf.sparkSession
    train, cal, test = splits(mf, cuts)
    # the fits pass over these columns many times
    train = train.select(LABEL, *(woe.selected_features(fitted, min_iv) if fitted else features)).cache()
    fitted = fitted or woe.fit(train, features)
    selected = woe.selected_features(fitted, min_iv)
    if not selected:
        best = max(fitted, key=lambda f: fitted[f].iv)
        raise ValueError(f"no feature reaches information value {min_iv}; the largest is {best} with {fitted[best].iv:.4f}")
    classes = _class_rows(train)
    n_train = sum(r["n_class"] for r in classes.values())
    woe_cols = [f"{f}_woe" for f in selected]
    tw = woe.transform(train, fitted, selected, keep=[LABEL]).withColumn("weight", _weight_column(classes, "class_weight"))
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol="weight",
                            regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False,
                            maxIter=1000, tol=1e-8)
    model = Pipeline(stages=[VectorAssembler(inputCols=woe_cols, outputCol="features"), lr]).fit(tw).stages[-1]
    train.unpersist()
    scorer = Scorer("scorecard", selected, None, {f: fitted[f] for f in selected},
                    [float(c) for c in model.coefficients.toArray()], float(model.intercept))
    scorer.knots = isotonic(scorer.raw(cal), "_raw")
    return _finish(run, scorer, test, log, artifacts,
                   {"min_iv": min_iv, "max_bins": woe.MAX_BINS, "min_bin_size": woe.MIN_BIN_SIZE,
                    "n_features_selected": len(selected)},
                   {"model_type": "woe_scorecard", "champion": "true"}, {},
                   {"fitted": fitted, "selected": selected, "iv_summary": woe.iv_summary(spark, fitted)},
                   (n_train, test.count()))


def scorecard_gradient(scorer: Scorer, train: DataFrame) -> DataFrame:
    """M8: ``feature, gradient`` of the penalised, class-weighted mean loss at the
    scorecard's coefficients, on the rows that it was trained on: zero at the optimum.
    One aggregate over the rows."""
    classes = _class_rows(train)
    n_train = sum(r["n_class"] for r in classes.values())
    columns = {f: woe.woe_column(scorer.bins[f]) for f in scorer.features}
    rows = scorer.raw(train).select(_weight_column(classes, "class_weight").alias("_w"), (1 / (1 + F.exp(-F.col("_raw"))) - F.col(LABEL)).alias("_e"),
                                    *[c.alias(f) for f, c in columns.items()])
    slopes = [(F.sum(F.col("_w") * F.col("_e") * F.col(f)) / F.sum("_w") + F.lit(c / n_train)).alias(f)
              for f, c in zip(scorer.features, scorer.coefficients)]
    level = (F.sum(F.col("_w") * F.col("_e")) / F.sum("_w")).alias("intercept")
    return rows.agg(*slopes, level).unpivot([], [*scorer.features, "intercept"], "feature", "gradient")


# ---------------------------------------------------------------- boosted trees

def columns_with_nulls(df: DataFrame, features: list[str]) -> list[str]:
    """One aggregate pass; the result is one number per feature."""
    row = df.agg(*[F.sum(F.col(f).isNull().cast("int")).alias(f) for f in features]).first()
    return [f for f in features if row[f]]


def train_boosted_trees(mf: DataFrame, features: list[str] | None = None,
                        log: RunLog | None = None, run: str = "boosted_trees_challenger_v1",
                        artifacts: str | None = None, cuts: dict | None = None, **params) -> Trained:
    """M17 + M9 + M15 + M18 on the mature vintages."""
    p = {**GBT_PARAMS, **params}
    train, cal, test = splits(mf, cuts)
    feats = present_features(mf, features or CHALLENGER_FEATURES)
    classes = _class_rows(train)
    n_train = sum(r["n_class"] for r in classes.values())
    train = spread(train.select("loan_id", LABEL, *feats), n_train).cache()
    nulls = columns_with_nulls(train, feats)
    spw = float(classes[0]["scale_pos_weight"]) if 0 in classes and 1 in classes else 1.0
    cols = prepared_columns("boosted_trees", feats, nulls)
    tr = train.select(LABEL, *[c.alias(n) for n, c in cols.items()])
    tr = tr.withColumn("_weight", F.when(F.col(LABEL) == 1, F.lit(spw)).otherwise(F.lit(1.0)))
    gbt = trees.BoostedTrees(featuresCol="_features", labelCol=LABEL, weightCol="_weight", predictionCol="_prediction",
                        **GBT_EXECUTION, **p)
    gbt.setRawPredictionCol("_rawPrediction").setProbabilityCol("_probability")
    model = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_features"), gbt]).fit(tr)
    train.unpersist()
    scorer = Scorer("boosted_trees", feats, with_nulls=nulls, pipeline=model)
    scorer.knots = isotonic(scorer.raw(cal), "_raw")
    names = [n.removeprefix("_f_") for n in cols]
    importance = sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist()), key=lambda t: (-t[1], t[0]))
    return _finish(run, scorer, test, log, artifacts, {**p, "scale_pos_weight": spw, "n_features": len(names)},
                   {"model_type": "gradient_boosted_trees", "champion": "false", "challenger": "true"}, {},
                   {"importance": importance, "features": names}, (n_train, test.count()))


def importance_frame(spark: SparkSession, importance: list[tuple[str, float]],
                     top: int = IMPORTANCE_TOP) -> DataFrame:
    """Top-k features by importance (a bounded list of features)."""
    rows = [(i + 1, f, float(v)) for i, (f, v) in enumerate(importance[:top])]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


# ---------------------------------------------------------------- neural net

def oversample_copies(ratio: float | F.Column, key: str = "loan_id") -> F.Column:
    """Copies of a row: positives floor(ratio) times and, by a hash of the key,
    once more for the fraction; others once."""
    ratio = F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio
    whole = F.floor(ratio)
    u = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit("os"))), 1, 8), 16, 10)
    extra = (u.cast("double") / float(2 ** 32) < ratio - whole).cast("int")
    return F.when(F.col(LABEL) == 1, whole + extra).otherwise(F.lit(1)).cast("int")


def oversample_positives(df: DataFrame, ratio: float, key: str = "loan_id") -> DataFrame:
    """Replicate positives ~ratio times. Deterministic (a function of the key), narrow."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), oversample_copies(ratio, key)))).drop("_copy")


def scaling_stats(train: DataFrame, features: list[str]) -> DataFrame:
    """Mean and sample deviation per feature after filling 0, on the
    training split; one row per feature."""
    filled = prepared_columns("neural_net", features, [])
    long = train.select(*[c.alias(n.removeprefix("_f_")) for n, c in filled.items()]).unpivot([], features, "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def train_neural_net(mf: DataFrame, features: list[str] | None = None,
                     log: RunLog | None = None, run: str = "neural_net_challenger_v1",
                     epochs: int = MLP_EPOCHS, hidden: list[int] | None = None, artifacts: str | None = None,
                     cuts: dict | None = None) -> Trained:
    """M20 + M21 + M23 (+ M9 calibration) on the mature vintages."""
    train, cal, test = splits(mf, cuts)
    feats = present_features(mf, features or CHALLENGER_FEATURES)
    classes = _class_rows(train)
    n_train = sum(r["n_class"] for r in classes.values())
    train = spread(train.select("loan_id", LABEL, *feats), n_train).cache()
    pos_w = float(classes[0]["scale_pos_weight"]) if 0 in classes and 1 in classes else 1.0
    cols = prepared_columns("neural_net", feats, [])
    filled = train.select("loan_id", LABEL, *[c.alias(n) for n, c in cols.items()])
    prep = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_unscaled"),
                            StandardScaler(inputCol="_unscaled", outputCol="_features",
                                           withMean=True, withStd=True)]).fit(filled)
    tr = prep.transform(filled).withColumn("_copies", oversample_copies(pos_w))
    mlp = MultilayerPerceptronClassifier(featuresCol="_features", labelCol=LABEL, rawPredictionCol="_rawPrediction",
                                         probabilityCol="_probability", predictionCol="_prediction",
                                         layers=[len(feats), *(hidden or MLP_HIDDEN), 2], maxIter=epochs,
                                         blockSize=MLP_BATCH, seed=42, solver="l-bfgs")
    t0 = time.time()
    net, history = perceptron.fit(mlp, tr, "_copies", np.float32)   # as the reference's tensors
    seconds = round(time.time() - t0, 1)
    train.unpersist()
    scorer = Scorer("neural_net", feats, pipeline=PipelineModel(stages=[*prep.stages, net]))
    scorer.knots = isotonic(scorer.raw(cal), "_raw")
    return _finish(run, scorer, test, log, artifacts,
                   {"hidden": hidden or MLP_HIDDEN, "epochs": epochs, "batch_size": MLP_BATCH, "pos_weight": pos_w,
                    "n_features": len(feats)},
                   {"model_type": "neural_net", "champion": "false", "challenger": "true"},
                   {"final_train_loss": history[-1] if history else None, "train_seconds": seconds},
                   {"loss_history": history}, (n_train, test.count()))


# ---------------------------------------------------------------- dispatcher

def train(name: str, mf: DataFrame, log: RunLog | None = None, **kw) -> Trained:
    """Train a model by name; unknown names raise."""
    table = {
        "scorecard": lambda: train_scorecard(mf, woe.SCORECARD_FEATURES, log=log, **kw),
        "boosted_trees": lambda: train_boosted_trees(mf, log=log, **kw),
        "neural_net": lambda: train_neural_net(mf, log=log, **kw),
    }
    if name not in table:
        raise ValueError(f"no model named {name!r}; there are {', '.join(table)}")
    return table[name]()
