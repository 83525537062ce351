"""Event-table cross-validation: declared roles, training weights, fold baselines and fitted probability models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.algebra import log_or_failure
from tessera.functions.lineage import cut
from tessera.operators import forest


@dataclass(frozen=True)
class EventTable:
    """Declared roles of the columns of an event table; nothing is inferred from names."""

    state: str
    group: str
    stratum: str
    fold: str
    features: tuple[str, ...] = ()
    weight: str | None = None

    def validated(self, rows: DataFrame) -> DataFrame:
        """The rows with weight w; raises if an identifier is null, a feature is not finite or a weight is negative."""
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        bad = [F.col(c).isNull() for c in (self.state, self.group, self.stratum, self.fold)]
        bad += [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | F.col(c).cast("double").isin(float("inf"), float("-inf")) for c in self.features]
        bad.append(weight.isNull() | (weight < 0) | F.isnan(weight))
        any_bad = bad[0]
        for b in bad[1:]:
            any_bad = any_bad | b
        n = rows.agg(F.sum(F.when(any_bad, 1).otherwise(0)).alias("n")).first()["n"]
        if n:
            raise ValueError(f"{n} rows break the declared roles")
        return rows.withColumn("w", weight)


#: Groups up to which their weights are sent to all executors; rows of a partition that learners keep in memory.
SENT, HELD = 500_000, 1_000_000


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows staged in partitions of at most about HELD, as learners keep their points of a partition together."""
    n, least = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return cut(rows.repartition(max(1, -(-n // HELD), min(2 * least, n // 20_000))))


def hierarchical_weights(rows: DataFrame, stratum: str, group: str) -> DataFrame:
    """Rows with training_weight 1 / (strata x groups in the stratum x rows of the group)."""
    per_group = rows.groupBy(stratum, group).agg(F.count("*").alias("rows_in_group"))
    per_stratum = per_group.groupBy(stratum).agg(F.count("*").alias("groups_in_stratum"))
    strata = per_stratum.agg(F.count("*").alias("strata"))
    sizes = per_group.join(per_stratum, stratum).crossJoin(F.broadcast(strata))
    sizes = sizes.withColumn("training_weight", 1.0 / (F.col("strata") * F.col("groups_in_stratum") * F.col("rows_in_group")))
    sizes = cut(sizes.select(stratum, group, "training_weight"))
    # few groups are sent to the rows: by a shuffle, all rows of a group would meet in one task
    return rows.join(F.broadcast(sizes) if sizes.count() <= SENT else sizes, [stratum, group])


def fold_baselines(rows: DataFrame, fold: str, stratum: str, state: str, alpha: float) -> DataFrame:
    """For each fold left out: smoothed state probabilities of all other rows, pooled and per stratum."""
    k = rows.select(state).distinct().count()
    folds = rows.select(fold).distinct()
    own = rows.groupBy(fold, stratum, state).agg(F.sum("w").alias("own"))
    every = rows.groupBy(stratum, state).agg(F.sum("w").alias("every"))
    grid = rows.select(stratum).distinct().crossJoin(rows.select(state).distinct()).crossJoin(folds)  # strata x states x folds
    left = grid.join(every, [stratum, state], "left").join(own, [fold, stratum, state], "left").withColumn("n", F.coalesce("every", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)))
    pooled = left.groupBy(fold, state).agg(F.sum("n").alias("n_pooled"))
    totals = left.groupBy(fold, stratum).agg(F.sum("n").alias("n_stratum"))
    whole = pooled.groupBy(fold).agg(F.sum("n_pooled").alias("n_all"))
    joined = left.join(pooled, [fold, state]).join(totals, [fold, stratum]).join(whole, fold)
    return joined.select(fold, stratum, state, ((F.col("n_pooled") + alpha) / (F.col("n_all") + alpha * k)).alias("p_pooled"), ((F.col("n") + alpha) / (F.col("n_stratum") + alpha * k)).alias("p_stratum"))


#: From the training rows of a fold and the roles to the same rows with a column training_weight.
WeightPolicy = Callable[[DataFrame, EventTable], DataFrame]


def _policy_weights(train: DataFrame, roles: EventTable, policy: WeightPolicy) -> DataFrame:
    """The policy's rows; raises if it changed their number, or gave weights that are not finite, negative or all zero."""
    weighted = policy(train, roles)
    x = F.col("training_weight").cast("double")
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))
    got = weighted.agg(F.count("*").alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"), F.sum(x).alias("total")).first()
    if got["n"] != train.count() or got["bad"] or not got["total"]:
        raise ValueError(f"the weight policy gave {got['n']} rows, {got['bad'] or 0} of them with weights that are not allowed, of total {got['total']}")
    return weighted


def _policy_baselines(rows: DataFrame, weighted: DataFrame, roles: EventTable, fold: object, alpha: float) -> DataFrame:
    """The rows of fold_baselines for one fold, from the training rows and weights of a policy."""
    k = rows.select(roles.state).distinct().count()
    seen = weighted.groupBy(roles.stratum, roles.state).agg(F.sum("training_weight").alias("n"))
    grid = rows.select(roles.stratum).distinct().crossJoin(rows.select(roles.state).distinct())  # strata x states
    cells = grid.join(seen, [roles.stratum, roles.state], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    pooled = cells.groupBy(roles.state).agg(F.sum("n").alias("n_pooled"))
    totals = cells.groupBy(roles.stratum).agg(F.sum("n").alias("n_stratum"))
    whole = cells.agg(F.sum("n").alias("n_all"))
    joined = cells.join(pooled, roles.state).join(totals, roles.stratum).crossJoin(F.broadcast(whole))
    return joined.select(F.lit(fold).alias(roles.fold), roles.stratum, roles.state, ((F.col("n_pooled") + alpha) / (F.col("n_all") + alpha * k)).alias("p_pooled"), ((F.col("n") + alpha) / (F.col("n_stratum") + alpha * k)).alias("p_stratum"))


def _learner(model: str | Estimator, columns: dict[str, str], total: float, n: int, seed: int) -> Estimator:
    """The named model, or a copy of the caller's probabilistic classifier on our columns (it must take weights)."""
    if isinstance(model, Estimator):
        lacking = sorted(c for c in columns if not model.hasParam(c))
        if lacking:
            raise ValueError(f"the estimator has no {lacking}")
        return model.copy({model.getParam(c): name for c, name in columns.items()})
    if model == "logit":
        return LogisticRegression(**columns, regParam=1.0 / (total * n), standardization=False, maxIter=100)
    raise ValueError(f"unknown model {model!r}")


def cross_validated(rows: DataFrame, roles: EventTable, model: str | Estimator = "logit", alpha: float = 0.5, seed: int = 0, policy: WeightPolicy | None = None) -> DataFrame:
    """Per group: pooled gain = stratum gain + context gain of a model fitted without the group's fold.

    model: "logit", "forest" or any classifier of Spark ML that gives probabilities and takes weights. A policy is given
    the training rows of each fold and weights them for the model and the baselines; without one, models weigh strata,
    groups and rows hierarchically and baselines use the event weights. One fit per fold; scoring all folds is one plan.
    A forest counts its rows in cells, and so reads them several times; other models' rows are staged.
    """
    rows = roles.validated(rows)
    if not policy:  # a policy may use any column, and its rows are its own
        rows = rows.select(*dict.fromkeys((roles.state, roles.group, roles.stratum, roles.fold, *roles.features, "w")))
        rows = rows if model == "forest" else _dealt(rows)
    weighted = None if policy else hierarchical_weights(rows, roles.stratum, roles.group)
    tallies = cut(rows.groupBy(roles.fold, roles.stratum, roles.state).agg(F.sum("w").alias("w")))
    baselines = None if policy else fold_baselines(tallies, roles.fold, roles.stratum, roles.state, alpha)
    scored, trains = None, {}
    for fold in sorted(r[0] for r in tallies.select(roles.fold).distinct().collect()):  # a few folds
        test = rows.filter(F.col(roles.fold) == fold)
        if policy:
            train = _policy_weights(rows.filter(F.col(roles.fold) != fold), roles, policy)
            one = _policy_baselines(rows, train, roles, fold, alpha)
            baselines = one if baselines is None else baselines.unionByName(one)
        else:
            train = weighted.filter(F.col(roles.fold) != fold)
        if model == "forest":
            trains[fold] = train
            continue
        total, n = train.agg(F.sum("training_weight"), F.count("*")).first()
        common = {"featuresCol": "__features", "labelCol": "__label", "weightCol": "training_weight"}
        learner = _learner(model, common, total, n, seed)
        fitted = Pipeline(stages=[StringIndexer(inputCol=roles.state, outputCol="__label", handleInvalid="keep", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=list(roles.features), outputCol="__features"), learner]).fit(train)
        out = fitted.transform(test).withColumn("p_model", F.element_at(vector_to_array("probability"), (F.col("__label") + 1).cast("int")))
        out = out.select(roles.fold, roles.group, roles.stratum, roles.state, "w", F.coalesce("p_model", F.lit(0.0)).alias("p_model"))
        scored = out if scored is None else scored.unionByName(out)
    if model == "forest":
        states = sorted(r[0] for r in tallies.select(roles.state).distinct().collect())
        scored = forest.cross_fitted(rows, trains, weighted, states, roles.state, roles.fold, (roles.group, roles.stratum), roles.features, seed)
    joined = scored.join(F.broadcast(baselines), [roles.fold, roles.stratum, roles.state])
    mean = lambda a, b: F.sum(F.col("w") * (log_or_failure(F.col(a)) - log_or_failure(F.col(b)))) / F.sum("w")
    return joined.groupBy(roles.stratum, roles.group).agg(mean("p_model", "p_pooled").alias("pooled_gain"), mean("p_stratum", "p_pooled").alias("stratum_gain"), mean("p_model", "p_stratum").alias("context_gain"), F.sum("w").alias("weight"))
