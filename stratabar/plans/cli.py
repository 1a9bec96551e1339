"""Command line: run, recovery, state, decision, data, redundancy, list."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.functions import features
from stratabar.operators import audit, decision, panel, recovery, redundancy, report, rules, walkforward
from stratabar.sources import bars, config, registry


def session() -> SparkSession:
    return SparkSession.builder.appName("stratabar").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def universe(spark: SparkSession, names, args, start=None, end=None, interval=None) -> DataFrame:
    return bars.load_universe(spark, names, config.data_root(), start=start, end=end, interval=interval, download=not args.offline, fresh=args.refresh)


def show(title: str, df: DataFrame, rows: int = 100) -> None:
    print(f"\n{title}")
    df.show(rows, truncate=False)


def run(spark, args):
    exp = config.read(args.config)
    prices = universe(spark, exp.universe, args, exp.start, exp.end)
    show("spans that differ", audit.span_mismatch(prices))
    swept = walkforward.sweep(spark, features.build(prices), exp.methods, exp.engine).persist()
    show("failed", swept.where("error is not null").select("symbol", "method", "error"))
    out = walkforward.results(swept)
    print("results:", bars.write(out, f"{exp.output}/results.parquet", ["symbol", "method"]))
    summary = report.state_summary(out)
    print("summary:", bars.write(summary, f"{exp.output}/summary.parquet"))
    show("summary", summary)


def state(spark, args):
    exp = config.read(args.config)
    prices = universe(spark, exp.universe, args, exp.start, args.as_of or exp.end)
    feats = features.build(prices)
    methods = [m if isinstance(m, str) else m[0] for m in exp.methods]
    fixed = [m for m in methods if m in rules.RULES]
    states = rules.states(feats, fixed) if fixed else None
    fitted = [m for m in methods if m not in rules.RULES]
    if fitted:
        more = unfitted(feats, fitted)
        states = more if states is None else states.unionByName(more)
    show("states", report.state_report(states, methods, args.as_of))
    show("last dates", audit.spread(audit.report(spark, prices)))


def unfitted(feats: DataFrame, methods: list[str]) -> DataFrame:
    """States of estimators with the parameters they have before any fit."""
    import pandas as pd

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date").reset_index(drop=True)
        got = walkforward.estimator(frame["method"].iloc[0]).states(frame)
        got = got.astype(object).where(got.notna(), None)
        for i, c in enumerate(("symbol", "date", "method")):
            got.insert(i, c, frame[c])
        return got

    wanted = feats.select("symbol", "date", "ret", "rv20", "close").withColumn("method", F.explode(F.array(*(F.lit(m) for m in methods))))
    return wanted.repartition("symbol", "method").groupBy("symbol", "method").applyInPandas(one, f"symbol string, date date, method string, {walkforward.STATE_SCHEMA}")


def decide(spark, args):
    exp = config.read(args.config)
    feats = features.build(universe(spark, exp.universe, args, exp.start, exp.end)).persist()
    methods = [m for m in exp.methods if (m if isinstance(m, str) else m[0]) != "always_range"]
    states = walkforward.results(walkforward.sweep(spark, feats, methods)).persist()
    grid, risk = decision.decision_value(states, feats, args.horizon, not args.no_control, args.common_window)
    grid = decision.deflated(grid).persist()
    print("calibration:", bars.write(grid, f"{exp.output}/calibration.parquet"))
    print("risk:", bars.write(risk, f"{exp.output}/risk.parquet"))
    show("Brier change by target", decision.by_target(grid))
    show("survivors", decision.winners(grid))
    show("harms", decision.harms(grid))
    show("risk by strategy", risk.groupBy("strategy").agg(*(F.avg(c).alias(c) for c in ("sharpe", "ann_vol", "max_drawdown", "dd_per_vol", "turnover_pa"))))


def data(spark, args):
    if args.catalogue:
        show("registry", registry.catalogue(spark))
        return
    names = args.symbols if args.symbols and len(args.symbols) > 1 else (args.symbols or ["indices"])[0]
    names = names if isinstance(names, list) or names in registry.UNIVERSES else [names]
    prices = universe(spark, names, args, args.start, args.end, args.interval).persist()
    rep = audit.report(spark, prices, args.interval)
    show("bars", rep)
    show("warnings", audit.warnings_of(spark, rep, args.interval))
    print(audit.search_space(len(registry.chosen(names)), 1, args.methods, args.targets))
    if args.panel:
        show("coverage", panel.coverage(prices, args.how))
        show("alignment", panel.breakdown(prices))
        show("cross-asset, last dates", panel.cross_asset_features(panel.returns(prices, args.how)).orderBy(F.desc("date")), 3)


def recover(spark, args):
    out = recovery.run(spark, args.methods or walkforward.methods(), args.seeds, args.n)
    show("recovery", out)
    if args.out:
        print(bars.write(out, args.out))


def redundant(spark, args):
    results = redundancy.specialists(bars.read_results(spark, args.results, args.start))
    if args.symbols:
        results = results.where(F.col("symbol").isin(*args.symbols))
    names = [r[0] for r in results.select("symbol").distinct().collect()]
    feats = features.build(universe(spark, names, args))
    show("effective number", redundancy.effective_number(results))
    show("loadings", redundancy.loadings(redundancy.decomposed(results)))
    grid = redundancy.gate(results, feats, args.horizon).persist()
    show("gate", grid.groupBy("variant").pivot("target").agg(F.avg("t_stat")))
    show("verdict", redundancy.verdict(grid))
    if args.out:
        print(bars.write(grid, args.out))


def names(spark, args):
    print("methods:", ", ".join(walkforward.methods()))
    print("universes:", ", ".join(registry.UNIVERSES))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratabar")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, func, *, configured=False, offline=True):
        p = sub.add_parser(name)
        p.set_defaults(func=func)
        if configured:
            p.add_argument("-c", "--config", required=True)
        if offline:
            p.add_argument("--offline", action="store_true")
            p.add_argument("--refresh", action="store_true")
        return p

    command("run", run, configured=True)
    p = command("recovery", recover, offline=False)
    p.add_argument("--seeds", type=int, default=8)
    p.add_argument("--n", type=int, default=2500)
    p.add_argument("--methods", nargs="*")
    p.add_argument("--out")
    command("state", state, configured=True).add_argument("--as-of")
    p = command("decision", decide, configured=True)
    p.add_argument("--horizon", type=int, default=5)
    p.add_argument("--no-control", action="store_true")
    p.add_argument("--common-window", action="store_true")
    p = command("data", data)
    p.add_argument("--symbols", nargs="*")
    p.add_argument("--interval")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--catalogue", action="store_true")
    p.add_argument("--methods", type=int, default=8)
    p.add_argument("--targets", type=int, default=3)
    p.add_argument("--panel", action="store_true")
    p.add_argument("--how", default="intersect", choices=("intersect", "union"))
    p = command("redundancy", redundant)
    p.add_argument("--results", required=True)
    p.add_argument("--symbols", nargs="*")
    p.add_argument("--start", default="2015-01-01")
    p.add_argument("--horizon", type=int, default=5)
    p.add_argument("--out")
    command("list", names, offline=False)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.func(session() if args.command != "list" else None, args)


if __name__ == "__main__":
    main()
