"""DuckDB SQL of the catalogue's queries, built from shared common table expressions."""

from __future__ import annotations

BARS = """
bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::DATE AS date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, 100 * pow(l_extendedprice / l_quantity, 0.01) AS p, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
  GROUP BY ALL
)"""
WEEKLY = """
weeks AS (
  SELECT symbol, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS week, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, max(date) AS last
  FROM bars GROUP BY ALL
), weekly AS (
  SELECT symbol, week AS date, open, high, low, close, volume, max(last) OVER (PARTITION BY symbol) AS data_end, max(week) OVER (PARTITION BY symbol) > max(last) OVER (PARTITION BY symbol) AS last_bar_partial FROM weeks
)"""


def features(source: str = "bars", periods: int = 252, name: str = "features") -> str:
    guard = lambda f, c, n: f"CASE WHEN count({c}) OVER w{n} >= {n} THEN {f}({c}) OVER w{n} END"
    frames = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in (5, 20, 50, 60, 200))
    return f"""
{name}_r AS (
  SELECT *, ln(close) - lag(ln(close)) OVER w AS ret, lag(close) OVER w AS prev, ln(close / lag(close, 20) OVER w) AS mom20, ln(close / lag(close, 60) OVER w) AS mom60, ln(nullif(volume, 0)) AS lnv
  FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY date)
), {name} AS (
  SELECT symbol, date, ret, {guard('stddev_samp', 'ret', 5)} * sqrt({periods}) AS rv5, {guard('stddev_samp', 'ret', 20)} * sqrt({periods}) AS rv20, {guard('stddev_samp', 'ret', 60)} * sqrt({periods}) AS rv60,
    mom20, mom60, ({guard('avg', 'close', 50)}) / ({guard('avg', 'close', 200)}) - 1 AS ma_spread, (high - low) / close AS range, abs(open - prev) / prev AS gap,
    (lnv - ({guard('avg', 'lnv', 20)})) / nullif({guard('stddev_samp', 'lnv', 20)}, 0) AS volz, abs(ret) / nullif(volume / ({guard('avg', 'volume', 20)}), 0) AS amihud, close
  FROM {name}_r WINDOW {frames}
)"""


def z(column: str, out: str, source: str, name: str, n: int = 252, least: int = 60, floor: float = 0.0, keys: str = "symbol") -> str:
    return f"""
{name} AS (
  SELECT *, ({column} - CASE WHEN count({column}) OVER w >= {least} THEN avg({column}) OVER w END) / (CASE WHEN count({column}) OVER w >= {least} AND stddev_samp({column}) OVER w > {floor} THEN stddev_samp({column}) OVER w END) AS {out}
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS {n - 1} PRECEDING)
)"""


def softmax(score: str, source: str, name: str, method: str) -> str:
    return f"""
{name}_s AS (SELECT symbol, date, least(1.0, greatest(-1.0, coalesce({score}, 0.0))) AS score FROM {source}),
{name}_e AS (SELECT *, exp(-2.0 * score) AS d, exp(0.6) AS r, exp(2.0 * score) AS u FROM {name}_s),
{name} AS (
  SELECT symbol, date, '{method}' AS method, d / (d + r + u) AS p_down, r / (d + r + u) AS p_range, u / (d + r + u) AS p_up,
    CASE WHEN d >= r AND d >= u THEN 'down' WHEN r >= u THEN 'range' ELSE 'up' END AS map_state, score FROM {name}_e
)"""


MA = z("ma_spread", "zz", "features", "ma_z") + "," + softmax("tanh(zz)", "ma_z", "ma_cross", "ma_cross")
SIGN = """
sign_t AS (
  SELECT *, (CASE WHEN count(ret) OVER w >= 60 THEN avg(ret) OVER w END) / nullif(CASE WHEN count(ret) OVER w >= 60 THEN stddev_samp(ret) OVER w END, 0) * sqrt(60.0) AS t
  FROM features WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)
),""" + softmax("tanh(t)", "sign_t", "return_sign", "return_sign")
RANGE = softmax("0.0", "features", "always_range", "always_range")
EWM = """
numbered AS (SELECT symbol, date, ln(close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars),
smooth AS (
  SELECT symbol, date, i, y AS e FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.date, n.i, s.e + (n.y - s.e) * 2.0 / 41 FROM smooth s JOIN numbered n ON n.symbol = s.symbol AND n.i = s.i + 1
),
slopes AS (SELECT symbol, date, e - lag(e) OVER (PARTITION BY symbol ORDER BY date) AS slope FROM smooth),""" + z("slope", "zz", "slopes", "slope_z") + "," + softmax("tanh(zz)", "slope_z", "ewma_slope", "ewma_slope")
STATES = MA + "," + SIGN + "," + RANGE + """,
states AS (SELECT * FROM ma_cross UNION ALL SELECT * FROM return_sign UNION ALL SELECT * FROM always_range)"""
TARGETS = """
fwd AS (
  SELECT symbol, date, rv20, CASE WHEN count(ret) OVER w >= 5 THEN sum(ret) OVER w END AS fr, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END * sqrt(252.0) AS fv
  FROM features WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)
),
mid AS (SELECT *, CASE WHEN count(fv) OVER w >= 60 THEN quantile_cont(fv, 0.5) OVER w END AS m FROM fwd WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
targets AS (
  SELECT symbol, date, CASE WHEN fr IS NOT NULL THEN coalesce(fr > 0, false)::INT::DOUBLE END AS direction,
    CASE WHEN fr IS NOT NULL THEN coalesce(fr < -rv20 / sqrt(252.0) * sqrt(5.0), false)::INT::DOUBLE END AS loss, CASE WHEN fr IS NOT NULL THEN coalesce(fv > m, false)::INT::DOUBLE END AS volatility FROM mid
)"""
DATES = """
n_symbols AS (SELECT count(DISTINCT symbol) AS n FROM bars),
shared AS (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT n FROM n_symbols)),
returns AS (SELECT b.symbol, b.date, ln(close) - lag(ln(close)) OVER (PARTITION BY b.symbol ORDER BY b.date) AS ret FROM bars b SEMI JOIN shared USING (date))"""
EDGE = """
edges AS (SELECT symbol, min(date) AS a, max(date) AS z FROM bars GROUP BY symbol),
edge AS (SELECT max(a) AS panel_start, min(z) AS panel_end, count(*) AS symbols FROM edges),
days AS (SELECT date, count(DISTINCT symbol) AS n FROM bars GROUP BY date)"""
# truth for recovery: the return-sign rule's state, as if it were the regime
LABELLED = """
labelled AS (
  SELECT m.symbol, 'ma_cross' AS method, m.date, CASE m.map_state WHEN 'down' THEN 0 WHEN 'range' THEN 1 ELSE 2 END AS pred, CASE t.map_state WHEN 'down' THEN 0 WHEN 'range' THEN 1 ELSE 2 END AS truth,
    m.p_down AS p0, m.p_range AS p1, m.p_up AS p2, row_number() OVER (PARTITION BY m.symbol ORDER BY m.date) - 1 AS pos
  FROM ma_cross m JOIN return_sign t USING (symbol, date)
),
cont AS (SELECT symbol, method, pred, truth, count(*) AS n FROM labelled GROUP BY ALL),
perms(perm, q0, q1, q2) AS (VALUES ('012', 0, 1, 2), ('021', 0, 2, 1), ('102', 1, 0, 2), ('120', 1, 2, 0), ('201', 2, 0, 1), ('210', 2, 1, 0)),
tried AS (SELECT symbol, method, perm, q0, q1, q2, coalesce(sum(n) FILTER (CASE pred WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END = truth), 0) AS agree FROM cont, perms GROUP BY ALL),
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY symbol, method ORDER BY agree DESC, perm) = 1),
renamed AS (SELECT l.*, b.q0, b.q1, b.q2, CASE pred WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END AS new FROM labelled l JOIN best b USING (symbol, method)),
tcp AS (SELECT symbol, method, pos AS cp, truth AS into_state FROM (SELECT *, lag(truth) OVER (PARTITION BY symbol, method ORDER BY pos) AS b FROM renamed) WHERE b <> truth),
pcp AS (SELECT symbol, method, pos, new AS state FROM (SELECT *, lag(new) OVER (PARTITION BY symbol, method ORDER BY pos) AS b FROM renamed) WHERE b <> new)"""


def query(*parts: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n" + select


def rounded(columns: str | list[str], digits: int = 8) -> str:
    names = columns.split() if isinstance(columns, str) else columns
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)
