"""How well states recover a known regime: label matching, balanced accuracy, ARI, Brier, detection and false alarms."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratabar.operators import rules, walkforward
from stratabar.sources import simulate

YEAR = 252.0
PERMUTATIONS = [("".join(map(str, p)), *p) for p in itertools.permutations(range(3))]


def labelled(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(symbol, method, date, pos, pred, true, p0..p2) of complete rows; pos counts them in order of date from nought."""
    code = F.when(F.col("map_state") == "down", 0).when(F.col("map_state") == "range", 1).when(F.col("map_state") == "up", 2)
    rows = results.where("map_state is not null").select("symbol", "method", "date", code.alias("pred"), F.col("p_down").alias("p0"), F.col("p_range").alias("p1"), F.col("p_up").alias("p2")).join(truth.select("symbol", "date", F.col("true_state").alias("true")), ["symbol", "date"]).where("true is not null")
    order = Window.partitionBy("symbol", "method").orderBy("date")
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def contingency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "method", "pred", "true").agg(F.count("*").alias("n"))


def best_permutation(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(symbol, method, perm, q0, q1, q2, agree): the relabelling of states 0, 1, 2 that agrees most; ties to the first in order."""
    perms = F.broadcast(spark.createDataFrame(PERMUTATIONS, "perm string, q0 int, q1 int, q2 int"))
    new = F.when(F.col("pred") == 0, F.col("q0")).when(F.col("pred") == 1, F.col("q1")).otherwise(F.col("q2"))
    tried = table.join(perms, F.lit(True)).groupBy("symbol", "method", "perm", "q0", "q1", "q2").agg(F.coalesce(F.sum(F.when(new == F.col("true"), F.col("n"))), F.lit(0)).alias("agree"))
    best = F.max_by(F.struct("perm", "q0", "q1", "q2", "agree"), F.struct(F.col("agree"), -F.col("perm").cast("int")))
    return tried.groupBy("symbol", "method").agg(best.alias("b")).select("symbol", "method", "b.*")


def matched(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows with ``new``, the relabelled state, and ``pt``, the relabelled probability of the true state's label."""
    perm = best_permutation(spark, contingency(rows))
    both = rows.join(perm.select("symbol", "method", "q0", "q1", "q2"), ["symbol", "method"])
    new = F.when(F.col("pred") == 0, F.col("q0")).when(F.col("pred") == 1, F.col("q1")).otherwise(F.col("q2"))
    return both.withColumn("new", new)


def balanced_accuracy(rows: DataFrame, pred: str = "new") -> DataFrame:
    """Mean recall over the true classes that occur."""
    recall = rows.groupBy("symbol", "method", "true").agg(F.avg((F.col(pred) == F.col("true")).cast("double")).alias("recall"))
    return recall.groupBy("symbol", "method").agg(F.avg("recall").alias("balanced_accuracy"))


def rand_index(table: DataFrame) -> DataFrame:
    """Adjusted Rand index from pairs within cells, rows and columns."""
    two = lambda c: c * (c - 1) / 2.0
    keys = ["symbol", "method"]
    cells = table.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    side = lambda c: table.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two(F.col("n"))).alias(c))
    joined = cells.join(side("pred"), keys).join(side("true"), keys)
    chance = F.col("pred") * F.col("true") / F.nullif(two(F.col("total")), F.lit(0.0))
    most = (F.col("pred") + F.col("true")) / 2.0
    return joined.select(*keys, F.when(most == chance, 1.0).otherwise((F.col("both") - chance) / F.nullif(most - chance, F.lit(0.0))).alias("ari"))


def brier(rows: DataFrame) -> DataFrame:
    """Mean squared distance of relabelled probabilities from the truth, from 0 to 2."""
    total = None
    for k in range(3):
        hit = (F.col(f"q{k}") == F.col("true")).cast("double")
        part = (F.col(f"p{k}") - hit) * (F.col(f"p{k}") - hit)
        total = part if total is None else total + part
    return rows.groupBy("symbol", "method").agg(F.avg(total).alias("brier"))


def changes(rows: DataFrame, column: str) -> DataFrame:
    """(symbol, method, pos, state) where a column's state differs from the row before."""
    order = Window.partitionBy("symbol", "method").orderBy("pos")
    moved = rows.select("symbol", "method", "pos", F.col(column).alias("state"), F.lag(column).over(order).alias("before"))
    return moved.where("before is not null and before <> state").select("symbol", "method", "pos", "state")


def detection(rows: DataFrame, pred: str = "new", horizon: int = 60, tolerance: int = 10) -> DataFrame:
    """(symbol, method, median_delay, detection_rate, false_alarms_pa).

    A true change is detected by the first predicted change into its state from
    ``tolerance`` before to ``horizon`` after it; a predicted change is a false
    alarm if no true change lies within ``tolerance``. Both are range joins
    inside (symbol, method).
    """
    keys = ["symbol", "method"]
    true = changes(rows, "true").select(*keys, F.col("pos").alias("cp"), F.col("state").alias("into"))
    told = changes(rows, pred)
    near = F.col("pos").between(F.col("cp") - tolerance, F.col("cp") + horizon) & (F.col("state") == F.col("into"))
    found = true.join(told, keys).where(near).groupBy(*keys, "cp").agg((F.min("pos") - F.first("cp")).alias("delay"))
    met = true.join(found, [*keys, "cp"], "left").groupBy(*keys).agg(F.median("delay").cast("double").alias("median_delay"), F.avg(F.col("delay").isNotNull().cast("double")).alias("detection_rate"))
    c = true.select(F.col("symbol").alias("s2"), F.col("method").alias("m2"), "cp")
    alarms = told.join(c, (F.col("symbol") == F.col("s2")) & (F.col("method") == F.col("m2")) & (F.abs(F.col("pos") - F.col("cp")) <= tolerance), "left_anti").groupBy(*keys).agg(F.count("*").alias("alarms"))
    years = rows.groupBy(*keys).agg((F.count("*") / YEAR).alias("years"))
    return years.join(met, keys, "left").join(alarms, keys, "left").select(*keys, "median_delay", "detection_rate", (F.coalesce("alarms", F.lit(0)) / F.col("years")).alias("false_alarms_pa"))


def metrics(spark: SparkSession, results: DataFrame, truth: DataFrame) -> DataFrame:
    """All recovery measures per symbol and method."""
    rows = labelled(results, truth)
    new = matched(spark, rows)
    keys = ["symbol", "method"]
    plain = new.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("true")).cast("double")).alias("accuracy"), F.avg((F.col("new") == F.col("true")).cast("double")).alias("matched_accuracy"))
    out = plain.withColumn("label_gap", F.col("matched_accuracy") - F.col("accuracy"))
    for part in (balanced_accuracy(new), rand_index(contingency(rows)), brier(new), detection(new)):
        out = out.join(part, keys, "left")
    return out


def run(spark: SparkSession, methods: list[str], seeds: int = 8, n: int = 2500, persistence: float = 0.985, train_share: float = 0.4) -> DataFrame:
    """Simulate, fit once on the first part, filter all, score the rest; mean by method, best balanced accuracy first."""
    from stratabar.functions import features

    bars = simulate.markets(spark, seeds, n, persistence)
    feats = features.build(bars).select("symbol", "date", "ret", "rv20", "close")
    cut = int(n * train_share)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date").reset_index(drop=True)
        est = walkforward.estimator(frame["method"].iloc[0])
        if est.fits:
            est.fit(frame.iloc[:cut])
        got = est.states(frame).iloc[cut:]
        got = got.astype(object).where(got.notna(), None)
        got.insert(0, "date", frame["date"].iloc[cut:])
        got.insert(0, "method", frame["method"].iloc[0])
        got.insert(0, "symbol", frame["symbol"].iloc[0])
        return got

    wanted = feats.withColumn("method", F.explode(F.array(*(F.lit(m) for m in methods)))).repartition(seeds * len(methods), "symbol", "method")
    states = wanted.groupBy("symbol", "method").applyInPandas(one, f"symbol string, date date, method string, {walkforward.STATE_SCHEMA}")
    scores = metrics(spark, states, bars)
    names = [c for c in scores.columns if c not in ("symbol", "method")]
    return scores.groupBy("method").agg(*(F.avg(c).alias(c) for c in names)).orderBy(F.desc("balanced_accuracy"))


def permutation_numpy(pred: np.ndarray, true: np.ndarray) -> tuple[int, ...]:
    """The same matching on arrays, for tests."""
    return max(itertools.permutations(range(3)), key=lambda p: sum(int(p[a] == b) for a, b in zip(pred, true, strict=True)))


RULES = tuple(rules.RULES)
