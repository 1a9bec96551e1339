"""The registered queries over bars derived from order lines, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.functions import calendar, features
from stratabar.functions.windows import zscore
from stratabar.operators import audit, decision, factored, panel, recovery, redundancy, report, retest, rules, walkforward
from stratabar.plans import oracles as o
from stratabar.sources import bars as source
from stratabar.sources import registry
from stratabar.streaming import online as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NATIVE = ("ma_cross", "return_sign", "always_range")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_lineitem(table(spark, sf_dir, "lineitem"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.build(daily(spark, sf_dir))


def native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.states(frame(spark, sf_dir), NATIVE)


def neat(df: DataFrame, columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns.split()})


def longs(df: DataFrame, columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns.split()})


# -- data ---------------------------------------------------------------------
PRICES = "open high low close volume"


@query(o.query(o.BARS, select=f"SELECT symbol, date, {o.rounded(PRICES)} FROM bars"))
def bars_daily(spark, sf_dir):
    return neat(daily(spark, sf_dir), PRICES)


@query(o.query(o.BARS, o.WEEKLY, select=f"SELECT symbol, date, {o.rounded(PRICES)}, data_end, last_bar_partial FROM weekly"))
def bars_weekly(spark, sf_dir):
    return neat(calendar.weekly(daily(spark, sf_dir)), PRICES)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


_REGISTRY = f"r(symbol, ticker, asset_class, description, note) AS (VALUES {_values(registry.INSTRUMENTS)}), u(universe, symbol, i) AS (VALUES {', '.join(f'({chr(39)}{u}{chr(39)}, {chr(39)}{s}{chr(39)}, {i})' for i, (u, m) in enumerate(registry.UNIVERSES.items()) for s in m)})"


@query(f"WITH {_REGISTRY} SELECT r.*, coalesce((SELECT string_agg(universe, ', ' ORDER BY i) FROM u WHERE u.symbol = r.symbol), '') AS universes FROM r")
def catalogue(spark, sf_dir):
    return registry.catalogue(spark)


@query(o.query(o.BARS, _REGISTRY, select="SELECT DISTINCT symbol FROM bars ANTI JOIN r USING (symbol)"))
def unregistered(spark, sf_dir):
    return audit.unregistered(spark, daily(spark, sf_dir))


_GAPS = """
steps AS (SELECT symbol, date, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS step FROM bars),
typical AS (SELECT symbol, greatest(median(step), 1.0) AS typical, count(*) AS n FROM steps GROUP BY symbol),
gaps AS (SELECT symbol, any_value(typical) AS typical, count(*) FILTER (step > 5 * typical AND n >= 3) AS n_gaps, max(step) FILTER (step > 5 * typical AND n >= 3) AS worst,
  arg_min(date, (-step, date)) FILTER (step > 5 * typical AND n >= 3) AS after FROM steps JOIN typical USING (symbol) GROUP BY symbol)"""


@query(o.query(o.BARS, _GAPS, select="SELECT symbol, typical::DOUBLE AS typical, n_gaps::BIGINT AS n_gaps, worst::BIGINT AS worst, after FROM gaps"))
def audit_gaps(spark, sf_dir):
    return longs(audit.gaps(daily(spark, sf_dir)), "n_gaps worst")


_REPORT = "rep AS (SELECT symbol, symbol AS ticker, 'unregistered' AS asset_class, count(*) AS bars, min(date) AS first, max(date) AS last, round(count(*) / 252.0, 1) AS years FROM bars GROUP BY symbol)"


@query(o.query(o.BARS, _GAPS, _REPORT, select="SELECT symbol, ticker, asset_class, bars, first, last, years, n_gaps::BIGINT AS n_gaps FROM rep JOIN gaps USING (symbol)"))
def audit_report(spark, sf_dir):
    return longs(audit.report(spark, daily(spark, sf_dir)), "bars n_gaps").select("symbol", "ticker", "asset_class", "bars", "first", "last", "years", "n_gaps")


@query(o.query(o.BARS, _REPORT, select="SELECT symbol, last, ((SELECT max(last) FROM rep) - last)::BIGINT AS behind, (SELECT max(last) FROM rep) - last > 5 AS laggard FROM rep"))
def asof_spread(spark, sf_dir):
    return longs(audit.spread(audit.report(spark, daily(spark, sf_dir))), "behind")


@query(o.query(o.BARS, select="SELECT (count(DISTINCT symbol) * 1 * 8 * 3)::BIGINT AS comparisons, round(sqrt(2 * ln(count(DISTINCT symbol) * 24)), 8) AS deflated_bar FROM bars"))
def search_space(spark, sf_dir):
    n = daily(spark, sf_dir).agg((F.count_distinct("symbol") * 24).alias("comparisons"))
    return n.select("comparisons", F.round(F.sqrt(2 * F.ln("comparisons")), 8).alias("deflated_bar"))


# -- features -----------------------------------------------------------------
COLUMNS = " ".join(features.FEATURES) + " close"


@query(o.query(o.BARS, o.features(), select=f"SELECT symbol, date, {o.rounded(COLUMNS)} FROM features"))
def features_daily(spark, sf_dir):
    return neat(frame(spark, sf_dir), COLUMNS)


QUERIES["features"], ORACLES["features"] = features_daily, ORACLES["features_daily"]


@query(o.query(o.BARS, o.WEEKLY, o.features("weekly", 52), select=f"SELECT symbol, date, {o.rounded(COLUMNS)} FROM features"))
def features_weekly(spark, sf_dir):
    return neat(features.build(calendar.at(daily(spark, sf_dir), "weekly")), COLUMNS).drop("periods_per_year")


@query(o.query(o.BARS, o.features(), o.z("ma_spread", "z", "features", "zz"), select="SELECT symbol, date, round(z, 8) AS z FROM zz"))
def zscore_ma_spread(spark, sf_dir):
    return frame(spark, sf_dir).select("symbol", "date", F.round(zscore("ma_spread"), 8).alias("z"))


# -- rules --------------------------------------------------------------------
PROBS = "p_down p_range p_up score"


def _state_query(method: str, *parts: str, recursive: bool = False) -> None:
    def run(spark, sf_dir):
        return neat(rules.RULES[method](frame(spark, sf_dir)), PROBS)

    QUERIES[f"state_{method}"] = run
    ORACLES[f"state_{method}"] = o.query(o.BARS, o.features(), *parts, select=f"SELECT symbol, date, map_state, {o.rounded(PROBS)} FROM {method}", recursive=recursive)


_state_query("ma_cross", o.MA)
_state_query("return_sign", o.SIGN)
_state_query("always_range", o.RANGE)
_state_query("ewma_slope", o.EWM, recursive=True)


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS score FROM lineitem), c AS (SELECT *, least(1.0, greatest(-1.0, score)) AS s FROM s), e AS (SELECT *, exp(-2.0 * s) AS d, exp(0.6) AS r, exp(2.0 * s) AS u FROM c) SELECT map_state, count(*) AS n, round(sum(p_up), 4) AS total FROM (SELECT CASE WHEN d >= r AND d >= u THEN 'down' WHEN r >= u THEN 'range' ELSE 'up' END AS map_state, u / (d + r + u) AS p_up FROM e) GROUP BY map_state")
def softmax_states(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*rules.softmax(F.col("l_discount") * 20 - 1))
    return rows.groupBy("map_state").agg(F.count("*").alias("n"), F.round(F.sum("p_up"), 4).alias("total"))


# -- panel --------------------------------------------------------------------
@query(o.query(o.BARS, o.DATES, select="SELECT date FROM shared"))
def panel_intersect(spark, sf_dir):
    return panel.shared_dates(daily(spark, sf_dir))


@query(o.query(o.BARS, select="SELECT s.symbol, d.date, round(b.close, 8) AS close FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.date = d.date AND b.symbol = s.symbol"))
def panel_union(spark, sf_dir):
    return neat(panel.aligned(daily(spark, sf_dir), "union"), "close")


@query(o.query(o.BARS, o.DATES, select="SELECT symbol, date, round(ret, 8) AS ret FROM returns"))
def panel_returns(spark, sf_dir):
    return neat(panel.returns(daily(spark, sf_dir)), "ret")


@query(o.query(o.BARS, o.DATES, select="SELECT symbol, count(*) AS own_bars, count(s.date) AS in_panel, count(*) - count(s.date) AS dropped, (SELECT count(*) FROM shared) - count(s.date) AS missing_in_panel FROM bars b LEFT JOIN shared s ON s.date = b.date GROUP BY symbol"))
def panel_coverage(spark, sf_dir):
    return panel.coverage(daily(spark, sf_dir))


@query(o.query(o.BARS, o.EDGE, select="SELECT panel_start, panel_end, count(*) AS available, count(*) FILTER (n = symbols) AS kept, count(*) FILTER (date < panel_start) AS leading, count(*) FILTER (date > panel_end) AS trailing, count(*) FILTER (date BETWEEN panel_start AND panel_end AND n < symbols) AS interior FROM days, edge GROUP BY ALL"))
def alignment_breakdown(spark, sf_dir):
    return panel.breakdown(daily(spark, sf_dir))


@query(o.query(o.BARS, o.EDGE, select="SELECT s.symbol, count(*) AS missing FROM days d JOIN edge e ON d.date BETWEEN e.panel_start AND e.panel_end AND d.n < e.symbols CROSS JOIN (SELECT DISTINCT symbol FROM bars) s ANTI JOIN bars b ON b.symbol = s.symbol AND b.date = d.date GROUP BY s.symbol"))
def alignment_blame(spark, sf_dir):
    return panel.blame(daily(spark, sf_dir))


_CORR = """
pairs AS (SELECT a.date, a.symbol AS sa, b.symbol AS sb, a.ret AS x, b.ret AS y FROM returns a JOIN returns b ON a.date = b.date AND a.symbol < b.symbol),
rolled AS (SELECT date, CASE WHEN count(x + y) OVER w >= 30 THEN corr(x, y) OVER w END AS c FROM pairs WINDOW w AS (PARTITION BY sa, sb ORDER BY date ROWS 59 PRECEDING))"""


@query(o.query(o.BARS, o.DATES, _CORR, select="SELECT date, round(CASE WHEN count(c) = (SELECT n * (n - 1) / 2 FROM n_symbols) THEN avg(c) END, 8) AS avg_corr FROM rolled GROUP BY date"))
def avg_corr(spark, sf_dir):
    return neat(panel.average_correlation(panel.returns(daily(spark, sf_dir))), "avg_corr")


@query(o.query(o.BARS, o.DATES, select="SELECT date, round(stddev_samp(ret), 8) AS dispersion FROM returns GROUP BY date"))
def dispersion(spark, sf_dir):
    return neat(panel.dispersion(panel.returns(daily(spark, sf_dir))), "dispersion")


@query(o.query(o.BARS, o.DATES, select="SELECT date, round(count(*) FILTER (ret > 0) / nullif(count(ret), 0), 8) AS breadth FROM returns GROUP BY date"))
def breadth(spark, sf_dir):
    return neat(panel.breadth(panel.returns(daily(spark, sf_dir))), "breadth")


@query(o.query(o.BARS, "two AS (SELECT * FROM bars WHERE symbol IN ('NO', 'RF'))", o.DATES.replace("FROM bars", "FROM two"), """
duo AS (SELECT a.date, a.ret AS x, b.ret AS y FROM returns a JOIN returns b ON a.date = b.date AND a.symbol = 'NO' AND b.symbol = 'RF'),
r AS (SELECT date, CASE WHEN count(x + y) OVER w >= 252 THEN (1 + abs(corr(x, y) OVER w)) / 2 END AS absorption FROM duo WINDOW w AS (ORDER BY date ROWS 251 PRECEDING))""", select="SELECT date, round(absorption, 8) AS absorption FROM r"))
def absorption_2sym(spark, sf_dir):
    two = daily(spark, sf_dir).where("symbol in ('NO', 'RF')")
    return neat(panel.absorption_ratio(panel.returns(two)), "absorption")


@query()
def absorption_ratio(spark, sf_dir):
    """Over all symbols; ``absorption_2sym`` is its case that SQL can express."""
    return neat(panel.absorption_ratio(panel.returns(daily(spark, sf_dir))), "absorption")


@query()
def cross_asset(spark, sf_dir):
    return neat(panel.cross_asset_features(panel.returns(daily(spark, sf_dir))), "avg_corr dispersion absorption breadth")


# -- summaries ----------------------------------------------------------------
@query(o.query(o.BARS, o.features(), o.STATES, """
f AS (SELECT *, map_state <> lag(map_state) OVER (PARTITION BY symbol, method ORDER BY date) AS flip FROM states),
g AS (SELECT symbol, method, count(*) AS n, avg((map_state = 'up')::INT) AS pct_up, avg((map_state = 'range')::INT) AS pct_range, avg((map_state = 'down')::INT) AS pct_down, coalesce(sum(flip::INT), 0)::BIGINT AS flips FROM f GROUP BY ALL)""",
    select="SELECT symbol, method, n, round(pct_up, 8) AS pct_up, round(pct_range, 8) AS pct_range, round(pct_down, 8) AS pct_down, flips, round(flips / greatest(n - 1, 1), 8) AS flip_rate, round(1.0 / nullif(flips / greatest(n - 1, 1), 0), 8) AS mean_duration FROM g"))
def state_summary(spark, sf_dir):
    return neat(longs(report.state_summary(native(spark, sf_dir)), "flips"), "pct_up pct_range pct_down flip_rate mean_duration")


_LAST = """
last AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY symbol, method ORDER BY date DESC) = 1),
ent AS (SELECT *, -(p_down * ln(greatest(p_down, 1e-12)) + p_range * ln(greatest(p_range, 1e-12)) + p_up * ln(greatest(p_up, 1e-12))) / ln(3.0) AS h FROM last),
per AS (SELECT symbol, max(date) AS date, count(*) AS methods, avg(p_down) AS p_down, avg(p_range) AS p_range, avg(p_up) AS p_up, avg(h) AS individual FROM ent GROUP BY symbol),
dec AS (SELECT *, -(p_down * ln(p_down) + p_range * ln(p_range) + p_up * ln(p_up)) / ln(3.0) AS uncertainty, CASE WHEN p_down >= p_range AND p_down >= p_up THEN 'down' WHEN p_range >= p_up THEN 'range' ELSE 'up' END AS consensus FROM per)"""


@query(o.query(o.BARS, o.features(), o.STATES, _LAST, select="SELECT symbol, date, methods, round(individual, 8) AS individual, round(uncertainty, 8) AS uncertainty, round(greatest(0, uncertainty - individual), 8) AS disagreement FROM dec"))
def entropy_decompose(spark, sf_dir):
    out = report.decomposed(report.latest(native(spark, sf_dir)))
    return neat(out.select("symbol", "date", "methods", "individual", "uncertainty", "disagreement"), "individual uncertainty disagreement")


@query(o.query(o.BARS, o.features(), o.STATES, _LAST, select="""SELECT d.symbol, d.date, consensus, round(d.p_down, 3) AS p_down, round(d.p_range, 3) AS p_range, round(d.p_up, 3) AS p_up, round(uncertainty, 3) AS uncertainty, round(greatest(0, uncertainty - individual), 3) AS disagreement,
  round((SELECT avg((l.map_state = d.consensus)::INT) FROM last l WHERE l.symbol = d.symbol), 3) AS agreement,
  (SELECT map_state FROM last l WHERE l.symbol = d.symbol AND method = 'ma_cross') AS m_ma_cross, (SELECT map_state FROM last l WHERE l.symbol = d.symbol AND method = 'return_sign') AS m_return_sign, (SELECT map_state FROM last l WHERE l.symbol = d.symbol AND method = 'always_range') AS m_always_range FROM dec d"""))
def state_report(spark, sf_dir):
    return report.state_report(native(spark, sf_dir), list(NATIVE))


# -- targets and scores -------------------------------------------------------
@query(o.query(o.BARS, o.features(), o.TARGETS, select="SELECT symbol, date, direction, loss, volatility FROM targets"))
def targets_h5(spark, sf_dir):
    return decision.targets(frame(spark, sf_dir))


_FLIP = """
chg AS (SELECT symbol, method, date, map_state, CASE WHEN map_state IS NULL THEN NULL WHEN lag(map_state) OVER w IS NULL OR lag(map_state) OVER w <> map_state THEN 1.0 ELSE 0.0 END AS c FROM states WINDOW w AS (PARTITION BY symbol, method ORDER BY date)),
inst AS (SELECT symbol, method, date, CASE WHEN count(c) OVER w >= 30 THEN avg(c) OVER w END AS flip_rate FROM chg WINDOW w AS (PARTITION BY symbol, method ORDER BY date ROWS 59 PRECEDING))"""


@query(o.query(o.BARS, o.features(), o.STATES, _FLIP, select="SELECT symbol, method, date, round(flip_rate, 8) AS flip_rate FROM inst"))
def instability(spark, sf_dir):
    return neat(decision.instability(native(spark, sf_dir)), "flip_rate")


_SCORED = "scored AS (SELECT s.symbol, s.method, s.date FROM states s JOIN features f USING (symbol, date) JOIN targets t USING (symbol, date) JOIN inst i ON i.symbol = s.symbol AND i.method = s.method AND i.date = s.date WHERE rv20 + rv60 + p_down + direction + loss + volatility + flip_rate IS NOT NULL)"


@query(o.query(o.BARS, o.features(), o.STATES, o.TARGETS, _FLIP, _SCORED, select="SELECT symbol, method, date FROM scored"))
def scored_index(spark, sf_dir):
    return decision.scored(native(spark, sf_dir), frame(spark, sf_dir), control=True).select("symbol", "method", "date")


@query(o.query(o.BARS, o.features(), o.STATES, o.TARGETS, _FLIP, _SCORED, select="SELECT symbol, method, date FROM scored SEMI JOIN (SELECT symbol, date FROM scored GROUP BY ALL HAVING count(DISTINCT method) = 3) USING (symbol, date)"))
def common_window(spark, sf_dir):
    return decision.common_window(decision.scored(native(spark, sf_dir), frame(spark, sf_dir), control=True)).select("symbol", "method", "date")


@query(o.query(o.BARS, "n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) > 750)", "b AS (SELECT symbol, n, unnest(generate_series(750, n - 1, 63)) AS start FROM n)", select="SELECT symbol, start, least(start + 63, n) AS stop, greatest(0, start - 5 - 1250) AS train_from, start - 5 AS train_end, greatest(0, start - 750) AS replay_from FROM b"))
def wf_folds(spark, sf_dir):
    return walkforward.fold_table(daily(spark, sf_dir))


@query(o.query(o.BARS, "n AS (SELECT symbol, count(*) AS n, count(*) // 6 AS size FROM bars GROUP BY symbol)", "k AS (SELECT *, unnest(generate_series(0, 4)) AS fold FROM n)", select="SELECT symbol, fold, n - 5 * size + fold * size - 5 AS train_end, n - 5 * size + fold * size AS start, n - 5 * size + (fold + 1) * size AS stop FROM k"))
def ts_split_folds(spark, sf_dir):
    n = daily(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")).withColumn("size", F.floor(F.col("n") / 6))
    k = n.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    start = F.col("n") - 5 * F.col("size") + F.col("fold") * F.col("size")
    return k.select("symbol", "fold", (start - 5).alias("train_end"), start.alias("start"), (start + F.col("size")).alias("stop"))


_LOSS = "losses AS (SELECT m.symbol, m.date, (m.p_up - t.direction) ** 2 AS loss_s, (r.p_up - t.direction) ** 2 AS loss_b FROM ma_cross m JOIN return_sign r USING (symbol, date) JOIN targets t USING (symbol, date) WHERE t.direction IS NOT NULL)"
_NW = """
e AS (SELECT symbol, date, loss_s - loss_b AS d, loss_s - loss_b - avg(loss_s - loss_b) OVER (PARTITION BY symbol) AS e FROM losses),
lags AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3, lag(e, 4) OVER w AS e4, lag(e, 5) OVER w AS e5 FROM e WINDOW w AS (PARTITION BY symbol ORDER BY date)),
nw AS (SELECT symbol, count(*) AS n, avg(d) AS mean_diff, sum(e * e) + 2 * (5 / 6.0 * sum(e * e1) + 4 / 6.0 * sum(e * e2) + 3 / 6.0 * sum(e * e3) + 2 / 6.0 * sum(e * e4) + 1 / 6.0 * sum(e * e5)) AS v FROM lags GROUP BY symbol)"""


@query(o.query(o.BARS, o.features(), o.STATES, o.TARGETS, _LOSS, _NW, select="SELECT symbol, n, round(mean_diff, 8) AS mean_diff, round(mean_diff / sqrt(greatest(v / n, 1e-18) / n), 6) AS t_stat FROM nw"))
def nw_dm_stat(spark, sf_dir):
    feats = frame(spark, sf_dir)
    p = redundancy.pivoted(rules.states(feats, ["ma_cross", "return_sign"]), ["ma_cross", "return_sign"], "p_up")
    rows = p.join(decision.targets(feats), ["symbol", "date"]).where("direction is not null")
    losses = rows.select("symbol", "date", *(F.pow(F.col(m) - F.col("direction"), 2.0).alias(n) for m, n in (("ma_cross", "loss_s"), ("return_sign", "loss_b"))))
    return neat(neat(decision.diebold_mariano(losses, ["symbol"], 5), "mean_diff"), "t_stat", 6)


_GRID = "grid AS (SELECT o_orderpriority AS symbol, o_orderstatus AS method, (o_orderkey % 7)::VARCHAR AS target, (count(*) % 97) / 970.0 AS p_value, ((sum(o_custkey) % 11) - 6)::DOUBLE / 1000 AS brier_delta, ((sum(o_custkey) % 13) - 8)::DOUBLE AS t_stat FROM orders GROUP BY ALL)"


@query(f"WITH {_GRID}, k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value, symbol, method, target) AS rk FROM grid), q AS (SELECT *, least(1.0, greatest(0.0, min(p_value * n / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS p_fdr, sqrt(2 * ln(greatest(n, 2)::DOUBLE)) AS t_threshold FROM k) SELECT symbol, method, target, round(p_fdr, 8) AS p_fdr, round(t_threshold, 8) AS t_threshold, p_fdr < 0.10 AND brier_delta < 0 AS survives_fdr, t_stat < -t_threshold AS survives_deflated FROM q")
def deflate_bh(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    grid = orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("method"), (F.col("o_orderkey") % 7).cast("string").alias("target")).agg(
        ((F.count("*") % 97) / 970.0).alias("p_value"), (((F.sum("o_custkey") % 11) - 6).cast("double") / 1000).alias("brier_delta"), ((F.sum("o_custkey") % 13) - 8).cast("double").alias("t_stat"))
    return neat(decision.deflated(grid), "p_fdr t_threshold").select("symbol", "method", "target", "p_fdr", "t_threshold", "survives_fdr", "survives_deflated")


_PERF = """
sized AS (SELECT m.symbol, m.date, f.ret, p_down, least(2.0, greatest(0.0, 0.10 / greatest(rv20, 1e-6))) AS b FROM ma_cross m JOIN features f USING (symbol, date) WHERE ret IS NOT NULL AND rv20 IS NOT NULL),
nextr AS (SELECT *, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS r FROM sized),
legs AS (SELECT symbol, date, r, unnest([{'s': 'buy_and_hold', 'w': 1.0::DOUBLE, 'c': 0.0::DOUBLE}, {'s': 'vol_target', 'w': b, 'c': 2.0}, {'s': 'vol_target_x_state', 'w': b * (1 - p_down), 'c': 2.0}]) AS leg FROM nextr WHERE r IS NOT NULL),
net AS (SELECT symbol, date, leg.s AS strategy, abs(leg.w - lag(leg.w, 1, 0.0) OVER w) AS turn, leg.w * r - abs(leg.w - lag(leg.w, 1, 0.0) OVER w) * leg.c / 1e4 AS net FROM legs WINDOW w AS (PARTITION BY symbol, leg.s ORDER BY date)),
eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY symbol, strategy ORDER BY date)) AS equity FROM net),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq)"""


@query(o.query(o.BARS, o.features(), o.MA, _PERF, select="SELECT symbol, 'ma_cross' AS method, strategy, count(*) AS n, round(avg(net) * sqrt(252.0) / nullif(stddev_pop(net), 0), 6) AS sharpe, round(stddev_pop(net) * sqrt(252.0), 6) AS ann_vol, round(min(dd), 6) AS max_drawdown, round(min(dd) / nullif(stddev_pop(net) * sqrt(252.0), 0), 6) AS dd_per_vol, round(avg(turn) * 252, 6) AS turnover_pa FROM dd GROUP BY ALL"))
def vol_target_perf(spark, sf_dir):
    feats = frame(spark, sf_dir)
    return neat(decision.risk_control(rules.states(feats, ["ma_cross"]), feats), "sharpe ann_vol max_drawdown dd_per_vol turnover_pa", 6)


@query(o.query(o.BARS, o.features(), select="SELECT symbol, date, (lead(ret) OVER (PARTITION BY symbol ORDER BY date) < -0.01)::INT::DOUBLE AS y FROM features"))
def big_move_target(spark, sf_dir):
    return retest.big_move(frame(spark, sf_dir))


@query(o.query(o.BARS, o.features(), "x AS (SELECT symbol, date, rv20, row_number() OVER w - 1 AS i, CASE WHEN lead(ret) OVER w IS NOT NULL THEN rv20 END AS x FROM features WINDOW w AS (PARTITION BY symbol ORDER BY date))", "c AS (SELECT *, count(x) OVER p AS c, quantile_cont(x, 1 / 3.0) OVER p AS a, quantile_cont(x, 2 / 3.0) OVER p AS b FROM x WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", select="SELECT symbol, date, round(CASE WHEN i >= 750 AND c >= 100 AND rv20 IS NOT NULL THEN a END, 8) AS q1, round(CASE WHEN i >= 750 AND c >= 100 AND rv20 IS NOT NULL THEN b END, 8) AS q2 FROM c"))
def expanding_terciles(spark, sf_dir):
    return neat(retest.tercile_cuts(frame(spark, sf_dir)), "q1 q2")


# -- redundancy ---------------------------------------------------------------
_SIGNALS = "signals AS (SELECT * FROM ma_cross UNION ALL SELECT * FROM return_sign UNION ALL SELECT * FROM ewma_slope)"
_THREE = (o.BARS, o.features(), o.MA, o.SIGN, o.EWM, _SIGNALS)
SIGNALS = ("ma_cross", "return_sign", "ewma_slope")


def signals(spark, sf_dir):
    return rules.states(frame(spark, sf_dir), SIGNALS)


@query(o.query(*_THREE, select="SELECT symbol, date, round(max(score) FILTER (method = 'ma_cross'), 8) AS ma_cross, round(max(score) FILTER (method = 'return_sign'), 8) AS return_sign, round(max(score) FILTER (method = 'ewma_slope'), 8) AS ewma_slope FROM signals GROUP BY ALL", recursive=True))
def signal_pivot(spark, sf_dir):
    return neat(redundancy.pivoted(signals(spark, sf_dir), list(SIGNALS)), " ".join(SIGNALS))


_Z = (*_THREE, o.z("score", "z", "signals", "sig_z", floor=1e-12, keys="symbol, method"))


@query(o.query(*_Z, select="SELECT symbol, method, date, round(z, 7) AS z FROM sig_z", recursive=True))
def causal_z(spark, sf_dir):
    return neat(redundancy.causal_z(signals(spark, sf_dir)), "z", 7)


_IDIO = "cons AS (SELECT symbol, method, date, z, CASE WHEN count(z) OVER w = 3 THEN avg(z) OVER w END AS consensus FROM sig_z WINDOW w AS (PARTITION BY symbol, date))"


@query(o.query(*_Z, _IDIO, select="SELECT symbol, method, date, round(consensus, 7) AS consensus, round(z - consensus, 7) AS idio FROM cons", recursive=True))
def consensus_idio(spark, sf_dir):
    return neat(redundancy.decomposed(signals(spark, sf_dir)).select("symbol", "method", "date", "consensus", "idio"), "consensus idio", 7)


@query(o.query(*_Z, _IDIO, select="SELECT symbol, method, round(corr(z, consensus), 7) AS loading, corr(z, consensus) < 0 AS negative FROM cons WHERE consensus IS NOT NULL GROUP BY ALL", recursive=True))
def loadings(spark, sf_dir):
    return neat(redundancy.loadings(redundancy.decomposed(signals(spark, sf_dir))), "loading", 7)


@query(o.query(*_THREE, "pc AS (SELECT a.symbol, a.method AS m, b.method AS n, corr(a.score, b.score) AS c FROM signals a JOIN signals b USING (symbol, date) GROUP BY ALL)", select="SELECT symbol, count(*) FILTER (m = n) AS methods, round(9 / sum(c * c), 7) AS effective_n FROM pc GROUP BY symbol", recursive=True))
def effective_n(spark, sf_dir):
    return neat(redundancy.effective_number(signals(spark, sf_dir)), "effective_n", 7)


_GATE = _GRID.replace("o_orderstatus AS method", "o_orderstatus AS x").replace("grid AS (", "g0 AS (") + ", grid AS (SELECT symbol, CASE x WHEN 'F' THEN 'consensus' WHEN 'O' THEN 'idio_a' ELSE 'idio_all' END AS variant, CASE x WHEN 'P' THEN 2 ELSE 1 END AS n_features, target, t_stat, brier_delta FROM g0)"


@query(f"WITH {_GATE}, b AS (SELECT sqrt(2 * ln(greatest(count(*), 2)::DOUBLE)) AS bar FROM grid), v AS (SELECT bar, count(*) AS tests, count(*) FILTER (t_stat < -bar AND brier_delta < 0 AND variant = 'consensus') AS consensus_wins, count(*) FILTER (t_stat < -bar AND brier_delta < 0 AND starts_with(variant, 'idio_') AND n_features = 1) AS idio_wins, min(t_stat) FILTER (variant = 'consensus') AS consensus_min_t, min(t_stat) FILTER (starts_with(variant, 'idio_') AND n_features = 1) AS idio_min_t FROM grid, b GROUP BY bar) SELECT round(bar, 8) AS bar, tests, consensus_wins, idio_wins, consensus_min_t, idio_min_t, CASE WHEN idio_wins > 0 THEN 'specialists add information beyond the consensus' WHEN consensus_wins > 0 THEN 'the consensus is all there is: specialists are redundant' ELSE 'neither the consensus nor any specialist clears the bar' END AS verdict FROM v")
def verdict(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    g = orders.groupBy(F.col("o_orderpriority").alias("symbol"), "o_orderstatus", (F.col("o_orderkey") % 7).cast("string").alias("target")).agg((((F.sum("o_custkey") % 11) - 6).cast("double") / 1000).alias("brier_delta"), ((F.sum("o_custkey") % 13) - 8).cast("double").alias("t_stat"))
    s = F.col("o_orderstatus")
    g = g.withColumn("variant", F.when(s == "F", "consensus").when(s == "O", "idio_a").otherwise("idio_all")).withColumn("n_features", F.when(s == "P", 2).otherwise(1))
    return neat(redundancy.verdict(g), "bar")


# -- recovery: the return-sign rule's states stand for the truth ------------------
def labelled(spark, sf_dir):
    feats = frame(spark, sf_dir)
    code = F.when(F.col("map_state") == "down", 0).when(F.col("map_state") == "range", 1).otherwise(2)
    truth = rules.return_sign(feats).select("symbol", "date", code.alias("true_state"))
    return recovery.labelled(rules.states(feats, ["ma_cross"]), truth)


_REC = (o.BARS, o.features(), o.MA, o.SIGN, o.LABELLED)


@query(o.query(*_REC, select="SELECT symbol, method, pred, truth, n FROM cont"))
def contingency(spark, sf_dir):
    return recovery.contingency(labelled(spark, sf_dir)).withColumnRenamed("true", "truth")


@query(o.query(*_REC, select="SELECT symbol, method, perm, agree::BIGINT AS agree FROM best"))
def label_match_perm(spark, sf_dir):
    return recovery.best_permutation(spark, recovery.contingency(labelled(spark, sf_dir))).select("symbol", "method", "perm", F.col("agree").cast("long").alias("agree"))


@query(o.query(*_REC, select="SELECT symbol, method, round(avg(rc), 8) AS balanced_accuracy FROM (SELECT symbol, method, truth, avg((new = truth)::INT) AS rc FROM renamed GROUP BY ALL) GROUP BY ALL"))
def balanced_accuracy(spark, sf_dir):
    return neat(recovery.balanced_accuracy(recovery.matched(spark, labelled(spark, sf_dir))), "balanced_accuracy")


@query(o.query(*_REC, "c2 AS (SELECT symbol, sum(n * (n - 1) / 2) AS both_, sum(n) AS t FROM cont GROUP BY symbol)", "a2 AS (SELECT symbol, sum(n * (n - 1) / 2) AS a FROM (SELECT symbol, pred, sum(n) AS n FROM cont GROUP BY ALL) GROUP BY symbol)", "b2 AS (SELECT symbol, sum(n * (n - 1) / 2) AS b FROM (SELECT symbol, truth, sum(n) AS n FROM cont GROUP BY ALL) GROUP BY symbol)", select="SELECT symbol, 'ma_cross' AS method, round((both_ - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 8) AS ari FROM c2 JOIN a2 USING (symbol) JOIN b2 USING (symbol)"))
def ari(spark, sf_dir):
    return neat(recovery.rand_index(recovery.contingency(labelled(spark, sf_dir))), "ari")


@query(o.query(*_REC, select="SELECT symbol, method, round(avg((p0 - (q0 = truth)::INT) ** 2 + (p1 - (q1 = truth)::INT) ** 2 + (p2 - (q2 = truth)::INT) ** 2), 8) AS brier FROM renamed GROUP BY ALL"))
def multiclass_brier(spark, sf_dir):
    return neat(recovery.brier(recovery.matched(spark, labelled(spark, sf_dir))), "brier")


@query(o.query(*_REC, "hit AS (SELECT t.symbol, t.cp, min(p.pos) - t.cp AS delay FROM tcp t JOIN pcp p ON p.symbol = t.symbol AND p.state = t.into_state AND p.pos BETWEEN t.cp - 10 AND t.cp + 60 GROUP BY t.symbol, t.cp)", "al AS (SELECT p.symbol, count(*) AS alarms FROM pcp p WHERE NOT EXISTS (SELECT 1 FROM tcp t WHERE t.symbol = p.symbol AND abs(t.cp - p.pos) <= 10) GROUP BY p.symbol)", "yr AS (SELECT symbol, count(*) / 252.0 AS years FROM renamed GROUP BY symbol)", "mt AS (SELECT t.symbol, median(delay)::DOUBLE AS median_delay, avg((delay IS NOT NULL)::INT) AS detection_rate FROM tcp t LEFT JOIN hit h ON h.symbol = t.symbol AND h.cp = t.cp GROUP BY t.symbol)", select="SELECT symbol, 'ma_cross' AS method, median_delay, round(detection_rate, 8) AS detection_rate, round(coalesce(alarms, 0) / years, 8) AS false_alarms_pa FROM yr LEFT JOIN mt USING (symbol) LEFT JOIN al USING (symbol)"))
def detection_delay(spark, sf_dir):
    return neat(recovery.detection(recovery.matched(spark, labelled(spark, sf_dir))), "detection_rate false_alarms_pa")


# -- recursions ---------------------------------------------------------------
def per_symbol(df: DataFrame, run, schema: str) -> DataFrame:
    return df.repartition("symbol").groupBy("symbol").applyInPandas(run, schema)


@query(o.query(o.BARS, o.features(), "zs AS (SELECT symbol, date, ret / (nullif(rv20, 0) / sqrt(252.0)) AS z FROM features)", "zn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM zs WHERE z IS NOT NULL)", """
cus AS (
  SELECT symbol, date, i, CASE WHEN z - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, z - 0.5) END AS up, CASE WHEN -z - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, -z - 0.5) END AS dn, CASE WHEN z - 0.5 > 5 THEN 2 WHEN -z - 0.5 > 5 THEN 0 ELSE 1 END AS declared FROM zn WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.date, n.i, CASE WHEN c.up + n.z - 0.5 > 5 OR c.dn - n.z - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, c.up + n.z - 0.5) END, CASE WHEN c.up + n.z - 0.5 > 5 OR c.dn - n.z - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, c.dn - n.z - 0.5) END,
    CASE WHEN c.up + n.z - 0.5 > 5 THEN 2 WHEN c.dn - n.z - 0.5 > 5 THEN 0 ELSE c.declared END FROM cus c JOIN zn n ON n.symbol = c.symbol AND n.i = c.i + 1
)""", select="SELECT symbol, date, declared::BIGINT AS declared, round(least(1.0, CASE declared WHEN 2 THEN up WHEN 0 THEN dn ELSE greatest(up, dn) END / 5), 7) AS evidence FROM cus", recursive=True))
def cusum_fixed(spark, sf_dir):
    import pandas as pd

    from stratabar.operators.online import cusum_run, standardised

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("date")
        f = f.assign(z=standardised(f["ret"].to_numpy(dtype=float), f["rv20"].to_numpy(dtype=float))).dropna(subset=["z"])
        declared, evidence = cusum_run(f["z"].to_numpy(), 0.5, 5.0)
        return pd.DataFrame({"symbol": f["symbol"], "date": f["date"], "declared": declared, "evidence": evidence})

    return neat(per_symbol(frame(spark, sf_dir).select("symbol", "date", "ret", "rv20"), run, "symbol string, date date, declared long, evidence double"), "evidence", 7)


@query(o.query(o.BARS, "yn AS (SELECT symbol, date, ln(close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars)", """
kal AS (
  SELECT symbol, NULL::DATE AS date, 0::BIGINT AS i, y AS lv, 0.0::DOUBLE AS sl, 1e6::DOUBLE AS a, 0.0::DOUBLE AS b, 1e2::DOUBLE AS c FROM yn WHERE i = 1
  UNION ALL
  SELECT symbol, date, i, pl + a1 / s * v, sl + b1 / s * v, a1 - a1 / s * a1, b1 - a1 / s * b1, c1 - b1 / s * b1 FROM (
    SELECT *, y - pl AS v, a1 + 1e-4 AS s FROM (
      SELECT n.symbol, n.date, n.i, n.y, k.lv + k.sl AS pl, k.sl, k.a + 2 * k.b + k.c + 1e-5 AS a1, k.b + k.c AS b1, k.c + 1e-8 AS c1 FROM kal k JOIN yn n ON n.symbol = k.symbol AND n.i = k.i + 1))
)""", select="SELECT symbol, date, round(sl, 7) AS slope, round(sqrt(greatest(c, 1e-12)), 7) AS sd FROM kal WHERE i > 0", recursive=True))
def kalman_fixed(spark, sf_dir):
    import numpy as np
    import pandas as pd

    from stratabar.operators.online import trend_filter

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("date")
        slope, sd, _ = trend_filter(np.log(f["close"].to_numpy(dtype=float)), 1e-5, 1e-8, 1e-4)
        return pd.DataFrame({"symbol": f["symbol"], "date": f["date"], "slope": slope, "sd": sd})

    return neat(per_symbol(daily(spark, sf_dir).select("symbol", "date", "close"), run, "symbol string, date date, slope double, sd double"), "slope sd", 7)


_HMM = """
em AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, exp(-0.5 * (ret + 1e-3) ** 2 / 4e-4) / sqrt(4e-4) AS b0, exp(-0.5 * ret ** 2 / 6.4e-5) / sqrt(6.4e-5) AS b1, exp(-0.5 * (ret - 1e-3) ** 2 / 1e-4) / sqrt(1e-4) AS b2 FROM features WHERE ret IS NOT NULL),
fw AS (
  SELECT symbol, date, i, b0 / (b0 + b1 + b2) AS a0, b1 / (b0 + b1 + b2) AS a1, b2 / (b0 + b1 + b2) AS a2 FROM em WHERE i = 1
  UNION ALL
  SELECT symbol, date, i, x0 / (x0 + x1 + x2), x1 / (x0 + x1 + x2), x2 / (x0 + x1 + x2) FROM (
    SELECT e.symbol, e.date, e.i, (0.97 * f.a0 + 0.01) * e.b0 AS x0, (0.97 * f.a1 + 0.01) * e.b1 AS x1, (0.97 * f.a2 + 0.01) * e.b2 AS x2 FROM fw f JOIN em e ON e.symbol = f.symbol AND e.i = f.i + 1)
)"""


@query(o.query(o.BARS, o.features(), _HMM, select="SELECT symbol, date, round(a0, 7) AS p_down, round(a1, 7) AS p_range, round(a2, 7) AS p_up FROM fw", recursive=True))
def hmm_forward_default(spark, sf_dir):
    import pandas as pd

    from stratabar.operators.chains import HmmGaussian

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=["ret"]).sort_values("date")
        p = HmmGaussian().filtered(f[["ret"]].to_numpy(dtype=float))
        return pd.DataFrame({"symbol": f["symbol"], "date": f["date"], "p_down": p[:, 0], "p_range": p[:, 1], "p_up": p[:, 2]})

    return neat(per_symbol(frame(spark, sf_dir).select("symbol", "date", "ret"), run, "symbol string, date date, p_down double, p_range double, p_up double"), "p_down p_range p_up", 7)


_READY = "ready AS (SELECT symbol, date, rv20, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS r FROM features WHERE ret IS NOT NULL AND rv20 IS NOT NULL QUALIFY lead(ret) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL)"


@query(o.query(o.BARS, o.features(), _READY, "rn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM ready)", """
ks AS (
  SELECT symbol, date, i, 2.0::DOUBLE AS w, 1 + 2.0 * r AS eq, greatest(1.0, 1 + 2.0 * r) AS pk FROM rn WHERE i = 1
  UNION ALL
  SELECT symbol, date, i, w, e2, greatest(pk, e2) FROM (SELECT *, eq * (1 + w * r) AS e2 FROM (SELECT n.symbol, n.date, n.i, n.r, k.eq, k.pk, CASE WHEN k.eq / k.pk - 1 <= -0.20 THEN 1.0 ELSE 2.0 END AS w FROM ks k JOIN rn n ON n.symbol = k.symbol AND n.i = k.i + 1))
)""", select="SELECT symbol, date, w FROM ks", recursive=True))
def kill_switch(spark, sf_dir):
    return retest.kill_switch(retest.ready_rows(frame(spark, sf_dir)))


@query(o.query(o.BARS, o.features(), _READY, select="SELECT symbol, date, round(r, 8) AS r, 2.0::DOUBLE AS none, 1.5::DOUBLE AS leverage_cap, round(least(2.0, 0.175 / greatest(rv20, 1e-6)), 8) AS vol_budget FROM ready"))
def limit_exposures(spark, sf_dir):
    return neat(retest.exposures(retest.ready_rows(frame(spark, sf_dir))), "r vol_budget")


# -- fits: checked by unit tests, as SQL has no such models ---------------------------
def _walk(method: str) -> None:
    def run(spark, sf_dir):
        return neat(walkforward.results(walkforward.sweep(spark, frame(spark, sf_dir), [method])), PROBS)

    QUERIES[f"walkforward_{method}"] = run


for _m in ("hmm_gaussian", "kalman_trend", "ms_regression", "cusum", "bocpd"):
    _walk(_m)


@query()
def calibration_gain(spark, sf_dir):
    feats = frame(spark, sf_dir)
    rows = decision.common_window(decision.scored(rules.states(feats, ["ma_cross", "return_sign"]), feats, control=True))
    return decision.deflated(decision.calibration_gain(rows, control=True))


@query()
def move_retest(spark, sf_dir):
    feats = frame(spark, sf_dir)
    return retest.move_retest(rules.states(feats, ["ma_cross"]), feats)


@query()
def limit_retest(spark, sf_dir):
    return retest.limit_retest(frame(spark, sf_dir))


@query()
def redundancy_gate(spark, sf_dir):
    return redundancy.gate(signals(spark, sf_dir), frame(spark, sf_dir))


@query()
def factored_vs_flat(spark, sf_dir):
    return factored.compare(frame(spark, sf_dir))[0]


@query()
def factored_stability(spark, sf_dir):
    return factored.compare(frame(spark, sf_dir))[1]


@query()
def run_recovery(spark, sf_dir):
    return recovery.run(spark, walkforward.methods())


# -- streams replayed as batches ----------------------------------------------------
@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 6) AS sum_value, max(value) AS max_value, min(value) AS min_value FROM events GROUP BY ALL")
def stream_hourly_bars(spark, sf_dir):
    return neat(streams.tumbling_bars(table(spark, sf_dir, "events")), "sum_value", 6)


@query("WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n, round(sum(value), 6) AS sum_value FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    return neat(streams.sessions(table(spark, sf_dir, "events")), "sum_value", 6)


@query("""
WITH RECURSIVE st AS (SELECT event_type, avg(value) AS m, coalesce(nullif(stddev_samp(value), 0), 1.0) AS s FROM events GROUP BY event_type),
zn AS (SELECT event_type AS key, ts, (value - m) / s AS z, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events JOIN st USING (event_type)),
cus AS (
  SELECT key, ts, z, i, CASE WHEN abs(z) - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, z - 0.5) END AS up, CASE WHEN abs(z) - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, -z - 0.5) END AS dn, CASE WHEN z - 0.5 > 5 THEN 2 WHEN -z - 0.5 > 5 THEN 0 ELSE 1 END AS declared FROM zn WHERE i = 1
  UNION ALL
  SELECT n.key, n.ts, n.z, n.i, CASE WHEN c.up + n.z - 0.5 > 5 OR c.dn - n.z - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, c.up + n.z - 0.5) END, CASE WHEN c.up + n.z - 0.5 > 5 OR c.dn - n.z - 0.5 > 5 THEN 0.0 ELSE greatest(0.0, c.dn - n.z - 0.5) END,
    CASE WHEN c.up + n.z - 0.5 > 5 THEN 2 WHEN c.dn - n.z - 0.5 > 5 THEN 0 ELSE c.declared END FROM cus c JOIN zn n ON n.key = c.key AND n.i = c.i + 1
)
SELECT key, ts, round(z, 6) AS z, declared::INTEGER AS declared, round(least(1.0, CASE declared WHEN 2 THEN up WHEN 0 THEN dn ELSE greatest(up, dn) END / 5), 6) AS evidence FROM cus""")
def stream_cusum(spark, sf_dir):
    """CUSUM over a file-fed stream of events, driven to its end."""
    events = table(spark, sf_dir, "events")
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    scales = {r[0]: (r[1], r[2] or 1.0) for r in stats.collect()}  # one row an event type
    stream = spark.readStream.schema(events.schema).format("parquet").option("pathGlobFilter", "*.parquet").load(_folder(spark, sf_dir))
    mean, sd = (F.create_map(*(x for k, v in scales.items() for x in (F.lit(k), F.lit(float(v[i])))))[F.col("event_type")] for i in (0, 1))
    return neat(streams.replay(streams.cusum(stream.select(F.col("event_type").alias("key"), "ts", ((F.col("value") - mean) / sd).alias("z"))), "stream-cusum"), "z evidence", 6)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A glob that file streams accept for the events table, be it one file or a folder."""
    return f"{sf_dir}/events.parquet*"



