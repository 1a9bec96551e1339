"""The shared causal feature frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabar.functions.windows import along, deviation, mean

FEATURES = ("ret", "rv5", "rv20", "rv60", "mom20", "mom60", "ma_spread", "range", "gap", "volz", "amihud")


def build(bars: DataFrame) -> DataFrame:
    """(symbol, date, eleven features, close): one exchange and one sort on (symbol, date).

    Yearly scaling follows ``periods_per_year`` where bars carry it, which is passed on, else 252.
    Every division is guarded, so undefined values are null.
    """
    w = along()
    carried = [c for c in ("periods_per_year",) if c in bars.columns]
    ann = F.sqrt(F.coalesce("periods_per_year", F.lit(252.0))) if "periods_per_year" in bars.columns else F.sqrt(F.lit(252.0))
    before = lambda n: F.lag("close", n).over(w)
    log = lambda c: F.when(c > 0, F.ln(c))
    one = bars.select(
        "symbol", "date", "open", "high", "low", "close", "volume", *carried, ann.alias("ann"),
        (log(F.col("close")) - log(before(1))).alias("ret"), before(1).alias("prev"),
        log(F.try_divide(F.col("close"), before(20))).alias("mom20"), log(F.try_divide(F.col("close"), before(60))).alias("mom60"),
        log(F.col("volume")).alias("lnv"),
    )
    return one.select(
        "symbol", "date", "ret",
        *((deviation("ret", n) * F.col("ann")).alias(f"rv{n}") for n in (5, 20, 60)), "mom20", "mom60",
        (F.try_divide(mean("close", 50), mean("close", 200)) - 1).alias("ma_spread"),
        F.try_divide(F.col("high") - F.col("low"), F.col("close")).alias("range"),
        F.try_divide(F.abs(F.col("open") - F.col("prev")), F.col("prev")).alias("gap"),
        F.try_divide(F.col("lnv") - mean("lnv", 20), F.nullif(deviation("lnv", 20), F.lit(0.0))).alias("volz"),
        F.try_divide(F.abs("ret"), F.try_divide(F.col("volume"), mean("volume", 20))).alias("amihud"), "close", *carried,
    )
