"""Estimators by name, cross-validated training, importances, search and rules from trees."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import unused
from .optimize import maximise
from .split import at_random, cut_off, fold
from .stats import auc, curve_within

FILL = -999
#: Classifiers that a specification may name; anything else is refused.
ESTIMATORS = {c.__name__: c for c in (C.LogisticRegression, C.DecisionTreeClassifier, C.RandomForestClassifier, C.GBTClassifier, C.NaiveBayes, C.LinearSVC, C.MultilayerPerceptronClassifier, C.FMClassifier)}
#: Names and parameters of boosted-tree libraries, as those of the estimators here.
ALIASES = {"XGBClassifier": "GBTClassifier", "GradientBoostingClassifier": "GBTClassifier", "LogisticRegressionEstimator": "LogisticRegression", "SVC": "LinearSVC", "MLPClassifier": "MultilayerPerceptronClassifier", "MultinomialNB": "NaiveBayes"}
PARAMS = {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth", "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode", "C": "regParam", "max_iter": "maxIter", "random_state": "seed"}


def make_estimator(name: str, params: dict | None = None, features: str = "features", label: str = "label", weight: str | None = None):
    """A classifier by allow-listed name with a dictionary of parameters; unknown parameters are refused."""
    cls = ESTIMATORS.get(ALIASES.get(name, name))
    if cls is None:
        raise ValueError(f"unknown estimator {name!r}")
    est = cls(featuresCol=features, labelCol=label)
    for k, v in (params or {}).items():
        k2 = "numTrees" if k == "n_estimators" and cls is C.RandomForestClassifier else PARAMS.get(k, k)
        v2 = 1 / v if k == "C" and v else v
        if not est.hasParam(k2):
            raise ValueError(f"{name} has no parameter {k!r}")
        est.set(est.getParam(k2), v2)
    if weight and est.hasParam("weightCol"):
        est.set(est.getParam("weightCol"), weight)
    return est


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df.fillna(FILL, columns))


def _vector(model) -> list[float]:
    v = model.featureImportances if hasattr(model, "featureImportances") else model.coefficientMatrix if hasattr(model, "coefficientMatrix") else model.coefficients
    a = v.toArray()
    return [float(x) for x in (abs(a).sum(axis=0) if a.ndim > 1 else abs(a))]


def importances(df: DataFrame, columns: list[str], label: str, estimator: str = "RandomForestClassifier", params: dict | None = None) -> list[tuple[str, float]]:
    """Columns by importance, or by the size of their coefficients, largest first."""
    m = make_estimator(estimator, params, label=label).fit(assemble(df, columns))
    return sorted(zip(columns, _vector(m), strict=True), key=lambda x: (-x[1], x[0]))


def coefficients(df: DataFrame, columns: list[str], label: str) -> dict[str, float]:
    m = C.LogisticRegression(labelCol=label).fit(assemble(df, columns))
    return dict(zip(columns, map(float, m.coefficients), strict=True))


def p_values(df: DataFrame, columns: list[str], label: str, family: str = "binomial") -> dict[str, float]:
    """Wald p-values of a model without intercept."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    m = GeneralizedLinearRegression(family=family, labelCol=label, fitIntercept=False).fit(assemble(df, columns))
    return dict(zip(columns, map(float, m.summary.pValues), strict=True))


def scaled_logistic(columns: list[str], label: str, **params) -> Pipeline:
    """Standardised columns into a logistic regression."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), C.LogisticRegression(labelCol=label, **params)])


def probability(df: DataFrame) -> F.Column:
    """Probability of class 1, or for models without probabilities a logistic of the margin."""
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    return 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))


#: Boosted trees, whose rounds can be scored one by one.
BOOSTED = ("GBTClassifier",)


def leaf_values(model) -> list[list[float]]:
    """For each tree the predictions of its leaves from left to right, as Spark numbers them."""
    return [[float(v) for v in re.findall(r"Predict: ([-\d.Ee+]+)", t.toDebugString)] for t in model.trees]


def staged_margins(model, df: DataFrame, name: str = "margins") -> DataFrame:
    """Add an array with the ensemble's margin after each of its rounds: running sums of the trees'
    weighted leaves, in one pass over the rows."""
    leaf = unused(df, "leaf")[0]
    weights = list(model.treeWeights)
    values = F.array(*[F.array(*[F.lit(w * v) for v in tree]) for w, tree in zip(weights, leaf_values(model), strict=True)])
    with_leaves = model.copy().setLeafCol(leaf).transform(df)
    terms = F.zip_with(values, vector_to_array(leaf), lambda v, at: F.get(v, at.cast("int")))
    running = F.aggregate(terms, F.array(F.lit(0.0)), lambda done, t: F.concat(done, F.array(F.element_at(done, -1) + t)))
    return with_leaves.withColumn(name, F.slice(running, 2, len(weights))).drop(*[c for c in with_leaves.columns if c not in df.columns])


def staged_auc(scored: DataFrame, label: str, *keys: str, margins: str = "margins") -> DataFrame:
    """``keys, round, auc``: AUC after every round (from 0) within keys, all of them in one grouped pass."""
    long = scored.select(*keys, label, F.posexplode(margins).alias("round", "margin"))
    return curve_within(long, [*keys, "round"], "margin", label).drop("ks")


def best_round(aucs: list[float], patience: int | None) -> int:
    """The round (from 0) of greatest AUC, the first of equal ones, among those before ``patience`` rounds
    have gone by without a better one."""
    best = 0
    for r, a in enumerate(aucs):
        if a is not None and (aucs[best] is None or a > aucs[best]):
            best = r
        elif patience is not None and r - best >= patience:
            break
    return best


@dataclass
class ModelTrainer:
    """Cross-validated classifier: optional covariate-shift weights, cut-off and balancing, folds
    stratified by a hash, out-of-fold scores, fold AUCs and a final fit on all rows.

    ``test_size`` sets rows aside first (a share, by hash of the id; ``holdout`` has their scores).
    ``early_stopping_rounds`` is for boosted trees: each fold scores its validation rows after every
    round and takes the round of greatest AUC before so many rounds without a better one; its scores
    are those of that round, and the final model has ``sum(best rounds) // folds + 1`` rounds. Without
    folds (``folds=0``) the rows set aside find the round. ``fold_metrics`` has the AUCs of each fold's
    training, validation and set-aside rows; ``report=False`` leaves out all but validation. A label
    of one class among the rows to be scored gives an AUC of None.
    """

    estimator: str = "LogisticRegression"
    params: dict = field(default_factory=dict)
    folds: int = 5
    seed: int = 7
    oversample: bool = False
    cut_off_ratio: float | None = None
    weight_col: str | None = None
    shift_thr: float | None = None
    early_stopping_rounds: int | None = None
    test_size: float = 0.0
    report: bool = False

    def fit(self, train: DataFrame, label: str, id_col: str, columns: list[str] | None = None, test: DataFrame | None = None) -> ModelTrainer:
        self.label, self.id_col = label, id_col
        self.columns = columns or [c for c in train.columns if c not in (label, id_col, self.weight_col)]
        boosted = ALIASES.get(self.estimator, self.estimator) in BOOSTED
        if self.early_stopping_rounds is not None and not boosted:
            raise ValueError(f"{self.estimator} has no rounds to stop at")
        if not self.folds and not self.test_size:
            raise ValueError("neither folds nor rows set aside to score")
        weight = self.weight_col
        if self.shift_thr is not None and test is not None:
            from .drift import detect_covariate_shift

            weighted, self.mcc = detect_covariate_shift(train, test, self.columns, id_col, seed=self.seed)
            if self.mcc >= self.shift_thr:
                train, weight = weighted.withColumnRenamed("weight", "__w"), "__w"
        if self.cut_off_ratio and weight:
            train = cut_off(train, weight, self.cut_off_ratio, [id_col])
        if self.oversample:
            n, p = train.agg(F.count(F.lit(1)), F.sum(label)).first()
            up = F.when(F.col(label) == 1, (n - p) / max(p, 1)).otherwise(1.0)
            train, weight = train.withColumn("__b", up * (F.col(weight) if weight else 1.0)), "__b"
        x = assemble(train, self.columns)
        x = at_random(x, self.test_size, [id_col], self.seed).withColumnRenamed("is_test", "__out") if self.test_size else x.withColumn("__out", F.lit(False))
        if self.folds:
            folded = fold(x.where(~F.col("__out")), label, self.folds, [id_col], "__fold", self.seed)
            x = folded.unionByName(x.where("__out").withColumn("__fold", F.lit(-1))) if self.test_size else folded
        else:
            x = x.withColumn("__fold", F.lit(-1))
        x = x.select(id_col, label, "features", "__fold", "__out", *([weight] if weight else [])).persist()
        rows = x.where(~F.col("__out"))
        est = make_estimator(self.estimator, self.params, label=label, weight=weight)
        scored = [self._scored(est.fit(rows.where(F.col("__fold") != k)), x, k) for k in range(self.folds)]
        if not self.folds:
            scored = [self._scored(est.fit(rows), x, -1)]
        self.best_rounds = self._best_rounds(scored) if self.early_stopping_rounds is not None else None
        scored = [self._at_round(s, None if self.best_rounds is None else self.best_rounds[i]) for i, s in enumerate(scored)]
        every = scored[0]
        for s in scored[1:]:
            every = every.unionAll(s)
        every = every.persist()
        role = F.col("__role")
        kept = every if self.report else every.where(role == ("val" if self.folds else "test"))
        found = {(r["__k"], r["__role"]): r["auc"] for r in curve_within(kept, ["__k", "__role"], "y_pred", "y_true").collect()}
        self.fold_metrics = [{"fold": k} | {f"{name}_auc": found.get((k, name)) for name in ("train", "val", "test") if (k, name) in found} for k in (range(self.folds) if self.folds else [-1])]
        self.fold_auc = [found.get((k, "val")) for k in range(self.folds)]
        self.rounds = None
        if self.best_rounds is not None:
            self.rounds = sum(self.best_rounds) // len(self.best_rounds) + 1
            est.set(est.getParam("maxIter"), self.rounds)
        self.model = est.fit(rows)
        self.holdout = self.transform(train.join(x.where("__out").select(id_col), id_col, "left_semi")) if self.test_size else None
        validation = every.where(role == "val") if self.folds else every.where(role == "test")
        self.out_of_fold = validation.select(id_col, F.col("__k").alias("__fold"), "y_true", "y_pred").persist()
        self.out_of_fold.count()
        every.unpersist()
        x.unpersist()
        return self

    def _scored(self, model, x: DataFrame, k: int) -> DataFrame:
        """Rows with their part in fold ``k`` and the model's probability, or its margins by round."""
        role = F.when(F.col("__out"), "test").when(F.col("__fold") == k, "val").otherwise("train")
        y = x.withColumns({"__role": role, "__k": F.lit(k)})
        if not self.report:
            y = y.where(F.col("__role") == ("val" if self.folds else "test"))
        if self.early_stopping_rounds is not None:
            return staged_margins(model, y)
        z = model.transform(y)
        return z.withColumn("y_pred", probability(z))

    def _best_rounds(self, scored: list[DataFrame]) -> list[int]:
        """The best round of each fold; the AUCs of all rounds and folds come from one grouped pass."""
        role, every = "val" if self.folds else "test", None
        for s in scored:
            one = s.where(F.col("__role") == role).select("__k", self.label, "margins")
            every = one if every is None else every.unionAll(one)
        found = {(r["__k"], r["round"]): r["auc"] for r in staged_auc(every, self.label, "__k").collect()}
        keys = range(self.folds) if self.folds else [-1]
        self.staged = [[found.get((k, r)) for r in range(1 + max((b for a, b in found if a == k), default=0))] for k in keys]
        return [best_round(a, self.early_stopping_rounds) for a in self.staged]

    def _at_round(self, scored: DataFrame, rounds: int | None) -> DataFrame:
        p = F.col("y_pred") if rounds is None else 1 / (1 + F.exp(-2 * F.get("margins", rounds)))
        return scored.select(self.id_col, "__k", "__role", F.col(self.label).alias("y_true"), p.alias("y_pred"))

    def summary(self) -> dict[str, dict[str, float]]:
        """Mean and standard deviation of each AUC over the folds."""
        out = {}
        for name in ("train_auc", "val_auc", "test_auc"):
            got = [m[name] for m in self.fold_metrics if m.get(name) is not None]
            if got:
                mean = sum(got) / len(got)
                out[name] = {"mean": mean, "std": (sum((g - mean) ** 2 for g in got) / len(got)) ** 0.5}
        return out

    def close(self) -> None:
        """Lets go of the out-of-fold scores that are kept in memory."""
        self.out_of_fold.unpersist()

    def transform(self, df: DataFrame) -> DataFrame:
        """``<id>, y_pred`` and, where the label is there, ``y_true``."""
        scored = self.model.transform(assemble(df, self.columns))
        return scored.select(self.id_col, *([F.col(self.label).alias("y_true")] if self.label in df.columns else []), probability(scored).alias("y_pred"))

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.columns, _vector(self.model), strict=True), key=lambda x: (-x[1], x[0]))


def _target(df: DataFrame, columns: list[str], label: str, id_col: str, estimator: str, folds: int, seed: int, test_size: float) -> Callable[[dict], float]:
    """Parameters to the mean AUC of the folds, or with fewer than two folds of rows set aside."""

    def score(params: dict) -> float:
        m = ModelTrainer(estimator, params, folds, seed) if folds > 1 else ModelTrainer(estimator, params, 0, seed, test_size=test_size)
        m.fit(df, label, id_col, columns)
        m.close()
        return sum(m.fold_auc) / len(m.fold_auc) if folds > 1 else m.fold_metrics[0]["test_auc"]

    return score


def search(df: DataFrame, columns: list[str], label: str, id_col: str, estimator: str, space: dict[str, tuple[float, float]], trials: int = 10, folds: int = 3, seed: int = 7, strategy: str = "gp", init_points: int | None = None, kappa: float = 2.576, batch: int = 2, test_size: float = 0.2) -> tuple[dict, list[dict]]:
    """Best parameters of a seeded search over a box (`optimize.maximise`): trials are trained
    ``batch`` at a time, side by side. Bounds of at least 1 give whole numbers. With fewer than two
    folds the score is the AUC of a share of ``test_size`` set aside.
    Returns (best trial, all trials), each with ``params`` and ``target`` (mean AUC)."""
    target = _target(df, columns, label, id_col, estimator, folds, seed, test_size)
    return maximise(target, space, trials, seed, strategy, init_points, kappa, batch, wrap=inheritable_thread_target(df.sparkSession))


def grid(df: DataFrame, columns: list[str], label: str, id_col: str, estimator: str, space: dict[str, list], folds: int = 3, seed: int = 7) -> tuple[dict, list[dict]]:
    """As `search`, over all combinations of listed values."""
    target = _target(df, columns, label, id_col, estimator, folds, seed, 0.2)
    done = [{"params": p, "target": target(p)} for p in (dict(zip(space, values, strict=True)) for values in itertools.product(*space.values()))]
    return max(done, key=lambda d: d["target"]), done


def single_feature_auc(df: DataFrame, columns: list[str], label: str, id_col: str, folds: int = 3, seed: int = 7) -> DataFrame:
    """``feature, auc``: the larger of a column's raw AUC and that of out-of-fold depth-5 trees on
    it alone, both reflected to 0.5 or more."""
    from .stats import auc_table

    trees = []
    for c in columns:
        t = ModelTrainer("DecisionTreeClassifier", {"max_depth": 5, "random_state": seed}, folds, seed).fit(df, label, id_col, [c])
        a = auc(t.out_of_fold, "y_pred", "y_true").first()[0]
        t.close()
        trees.append((c, None if a is None else float(max(a, 1 - a))))
    out = df.sparkSession.createDataFrame(trees, "feature string, tree double")  # a row for each column
    return auc_table(df, columns, label).join(F.broadcast(out), "feature").select("feature", F.greatest("auc", "tree").alias("auc"))


@dataclass
class MixtureLR:
    """Mixture of logistic regressions: softmax gates over sigmoid experts, by gradient descent
    whose gradients Spark sums over all rows; the driver holds only the weights."""

    experts: int = 2
    steps: int = 30
    rate: float = 0.5
    seed: int = 7

    def fit(self, df: DataFrame, label: str, columns: list[str]) -> MixtureLR:
        import numpy as np
        import pandas as pd

        self.columns = columns
        r = df.agg(F.count(F.lit(1)), *[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
        n, self.mean, self.scale = r[0], np.array(r[1::2], float), np.array([x or 1.0 for x in r[2::2]], float)
        x = df.select(F.col(label).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(float(m))).alias(c) for c, m in zip(columns, self.mean, strict=True)]).persist()
        rng, k, d = np.random.default_rng(self.seed), self.experts, len(columns) + 1
        u, w = rng.normal(0, 0.1, (d, k)), rng.normal(0, 0.1, (d, k))
        mean, scale = self.mean, self.scale
        for _ in range(self.steps):
            def grads(batches, u=u, w=w):
                gu, gw = np.zeros_like(u), np.zeros_like(w)
                for b in batches:
                    z = np.hstack([(b[columns].to_numpy(float) - mean) / scale, np.ones((len(b), 1))])
                    g, s, p = _mixture(z, u, w)
                    dp = (p - b["y"].to_numpy()) / np.maximum(p * (1 - p), 1e-9)
                    gu += z.T @ (dp[:, None] * g * (s - p[:, None]))
                    gw += z.T @ (dp[:, None] * g * s * (1 - s))
                yield pd.DataFrame({"i": np.arange(2 * u.size), "g": np.concatenate([gu.ravel(), gw.ravel()])})

            g = x.mapInPandas(grads, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy() / n
            u, w = u - self.rate * g[: u.size].reshape(u.shape), w - self.rate * g[u.size :].reshape(w.shape)
        x.unpersist()
        self.gates, self.weights = u, w
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        z = [(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)] + [F.lit(1.0)]
        dot = lambda a, j: sum((x * float(v) for x, v in zip(z, a[:, j], strict=True)), F.lit(0.0))
        gate = [F.exp(dot(self.gates, j)) for j in range(self.experts)]
        expert = [1 / (1 + F.exp(-dot(self.weights, j))) for j in range(self.experts)]
        return df.withColumn("y_pred", sum((g * e for g, e in zip(gate, expert, strict=True)), F.lit(0.0)) / sum(gate, F.lit(0.0)))


def _mixture(z, u, w):
    import numpy as np

    g = np.exp(z @ u - (z @ u).max(axis=1, keepdims=True))
    g /= g.sum(axis=1, keepdims=True)
    s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return g, s, np.clip((g * s).sum(axis=1), 1e-9, 1 - 1e-9)
