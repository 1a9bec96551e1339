"""State summaries and the latest-state report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabar.functions.windows import along


def entropy(*p: Column) -> Column:
    """Entropy over ln 3, probabilities floored at 1e-12."""
    floor = [F.greatest(x, F.lit(1e-12)) for x in p]
    total = floor[0] * 0
    for x in floor:
        total = total - x * F.ln(x)
    return total / F.ln(F.lit(3.0))


def state_summary(results: DataFrame) -> DataFrame:
    """Per symbol and method: rows, shares of states, flips, flip rate and mean duration over complete rows."""
    w = along("symbol", "method")
    seen = results.where("map_state is not null").withColumn("flip", (F.col("map_state") != F.lag("map_state").over(w)).cast("int"))
    share = lambda s: F.avg((F.col("map_state") == s).cast("double")).alias(f"pct_{s}")
    out = seen.groupBy("symbol", "method").agg(F.count("*").alias("n"), share("up"), share("range"), share("down"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"))
    rate = F.col("flips") / F.greatest(F.col("n") - 1, F.lit(1))
    return out.withColumn("flip_rate", rate).withColumn("mean_duration", F.try_divide(F.lit(1.0), F.nullif(rate, F.lit(0.0))))


def latest(results: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each method's last complete state per symbol, by partial maxima and without a sort."""
    rows = results.where("p_down is not null and p_range is not null and p_up is not null")
    if as_of:
        rows = rows.where(F.col("date") <= F.lit(as_of).cast("date"))
    best = F.max_by(F.struct("date", "p_down", "p_range", "p_up", "map_state", "score"), "date")
    return rows.groupBy("symbol", "method").agg(best.alias("s")).select("symbol", "method", "s.*")


def decomposed(last: DataFrame) -> DataFrame:
    """Per symbol: mean probabilities, entropy of the mean, and the part of it that is disagreement between methods."""
    own = entropy(F.col("p_down"), F.col("p_range"), F.col("p_up"))
    per = last.groupBy("symbol").agg(F.max("date").alias("date"), F.count("*").alias("methods"), *(F.avg(p).alias(p) for p in ("p_down", "p_range", "p_up")), F.avg(own).alias("individual"))
    total = entropy(F.col("p_down"), F.col("p_range"), F.col("p_up"))
    return per.withColumn("uncertainty", total).withColumn("disagreement", F.greatest(F.lit(0.0), F.col("uncertainty") - F.col("individual")))


def top_state() -> Column:
    d, r, u = F.col("p_down"), F.col("p_range"), F.col("p_up")
    return F.when((d >= r) & (d >= u), "down").when(r >= u, "range").otherwise("up")


def state_report(results: DataFrame, methods: list[str], as_of: str | None = None) -> DataFrame:
    """One row a symbol: consensus, agreement, probabilities, entropies and each method's state, n/a where it has none."""
    last = latest(results, as_of)
    base = decomposed(last).withColumn("consensus", top_state())
    agree = last.join(base.select("symbol", "consensus"), "symbol").groupBy("symbol").agg(F.avg((F.col("map_state") == F.col("consensus")).cast("double")).alias("agreement"))
    wide = last.groupBy("symbol").pivot("method", methods).agg(F.first("map_state"))
    names = [F.coalesce(F.col(f"`{m}`"), F.lit("n/a")).alias(f"m_{m}") for m in methods]
    rounded = [F.round(c, 3).alias(c) for c in ("p_down", "p_range", "p_up", "uncertainty", "disagreement", "agreement")]
    return base.join(agree, "symbol").join(wide, "symbol").select("symbol", "date", "consensus", *rounded, *names).orderBy("symbol")
