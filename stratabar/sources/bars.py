"""Price bars: schema, sources in order of precedence, tidying and sinks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from stratabar.functions import calendar
from stratabar.sources import registry

PRICES = ("open", "high", "low", "close", "volume")
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in PRICES)])
RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("Date", "Open", "High", "Low", "Close", "Volume")])
COMMITTED, CACHED, VENDOR = "committed CSV", "parquet cache", "vendor"


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars from order lines: one symbol for each return flag and line status.

    The price is compressed to equity-like volatility; the first and last trade
    of a day follow the four-part line key, which has no ties. One shuffle on
    (symbol, date) with partial aggregation.
    """
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    price = 100 * F.pow(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(0.01))
    lines = lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), price.alias("p"), key.alias("k"), "l_quantity")
    return lines.groupBy("symbol", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"))


def tidy(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Any table with Date and the five price columns, in any case, as bars.

    Unreadable dates and numbers become null, rows without a close or date go;
    equal dates stay. A missing column is an error.
    """
    names = {c.lower(): c for c in raw.columns}
    missing = [c for c in ("date", *PRICES) if c not in names]
    if missing:
        raise ValueError(f"price table lacks {', '.join(missing)}; it has {', '.join(raw.columns)}")
    cols = [F.to_date(F.try_to_timestamp(F.col(names["date"]).cast("string"))).alias("date"), *(F.col(names[c]).try_cast("double").alias(c) for c in PRICES)]
    who = F.lit(symbol.upper()) if symbol else F.col(names["symbol"])
    out = raw.select(who.alias("symbol"), *cols)
    real = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    return out.withColumns({c: real(c) for c in PRICES}).where("date is not null and close is not null")


def trimmed(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends inclusive; on the scan, so the filter is pushed down."""
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    return bars.where(F.col("date") <= F.lit(end).cast("date")) if end else bars


class PriceVendor(DataSource):
    """Plug-in point for a vendor download: ``spark.read.format('price_vendor')``.

    The option ``fetch`` names a module:function that yields rows of BARS for
    a ticker; without one the source has no rows, as there is no network here.
    """

    @classmethod
    def name(cls) -> str:
        return "price_vendor"

    def schema(self) -> T.StructType:
        return BARS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _VendorReader(self.options)


class _VendorReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def read(self, partition):
        import importlib

        where = self.options.get("fetch")
        if not where:
            return iter(())
        module, _, function = where.partition(":")
        return iter(getattr(importlib.import_module(module), function)(self.options["ticker"], self.options.get("start"), self.options.get("end")))


def readable(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The table at ``path``, or None where it cannot be read."""
    try:
        df = spark.read.schema(RAW).option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
        df.limit(1).count()
        return df
    except Exception:  # noqa: BLE001  an unreadable cache is no error; the next source is tried
        return None


def load(spark: SparkSession, symbol: str, root: str, start: str | None = None, end: str | None = None, interval: str | None = None, download: bool = False, fresh: bool = False, fetch: str | None = None) -> DataFrame:
    """Bars of one symbol from the committed CSV, else the cache, else the vendor.

    ``fresh`` passes over the CSV but not the cache. Rows are trimmed before
    weekly bars are made. ``source`` tells where they came from.
    """
    name = symbol.upper()
    found, source = None, ""
    if not fresh and (csv := readable(spark, f"{root}/raw/{name}.csv", "csv")) is not None:
        found, source = tidy(csv, name), COMMITTED
    if found is None and (cached := readable(spark, f"{root}/cache/{name}.parquet", "parquet")) is not None:
        found, source = tidy(cached, name), CACHED
    if found is None and download:
        spark.dataSource.register(PriceVendor)
        reader = spark.read.format("price_vendor").option("ticker", registry.lookup(name)["ticker"])
        for key, value in (("fetch", fetch), ("start", start), ("end", end)):
            reader = reader.option(key, value) if value else reader
        found, source = reader.load().withColumn("symbol", F.lit(name)), VENDOR
        if not found.limit(1).count():
            raise ValueError(f"the vendor has no rows for {name}")
        cache(found, root, name)
    if found is None:
        raise FileNotFoundError(f"no prices for {name} under {root}")
    out = trimmed(found, start, end)
    if not out.limit(1).count():
        raise ValueError(f"no prices for {name} between {start} and {end}")
    return calendar.at(out, interval).withColumn("source", F.lit(source))


def cache(df: DataFrame, root: str, name: str) -> str:
    """Keep vendor rows as Parquet or, where that fails, as CSV for the eye; only the Parquet is read again."""
    try:
        return write(df, f"{root}/cache/{name}.parquet")
    except Exception:  # noqa: BLE001  a cache that cannot be written must not lose the rows
        path = f"{root}/cache/{name}.csv"
        df.write.mode("overwrite").option("header", True).csv(path)
        return path


def held(spark: SparkSession, symbols: list[str], root: str, fresh: bool) -> tuple[DataFrame | None, set[str]]:
    """(bars with their source, symbols) of all files at hand, a committed CSV before a cached table; one scan of each kind."""
    jvm, out, own = spark._jvm, None, set()
    for kind, folder, source in (("csv", "raw", COMMITTED), ("parquet", "cache", CACHED)):
        if fresh and kind == "csv":
            continue
        paths = {s: f"{root}/{folder}/{s}.{kind}" for s in symbols if s not in own}
        there = {s: p for s, p in paths.items() if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)}
        if not there:
            continue
        raw = spark.read.schema(RAW).option("header", True).csv(list(there.values())) if kind == "csv" else spark.read.parquet(*there.values())
        of = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), rf"/{folder}/([^/]+)[.]{kind}(?:/|$)", 1)
        one = tidy(raw.drop("symbol").withColumn("symbol", of)).withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
        own |= set(there)
    return out, own


def load_universe(spark: SparkSession, names: str | list[str], root: str, **options) -> DataFrame:
    """One long table of a universe's bars; symbols that fail are skipped with a warning.

    Files at hand are read in one scan and counted in one job; only if one of
    them cannot be read, or for the vendor, are symbols loaded one by one.
    """
    symbols = registry.chosen(names)
    found = []
    try:
        out, own = held(spark, symbols, root, options.get("fresh", False))
        out = None if out is None else trimmed(out, options.get("start"), options.get("end"))
        full = set() if out is None else {r[0] for r in out.select("symbol").distinct().collect()}  # at most the symbols asked for
        for symbol in sorted(own - full):
            warnings.warn(f"{symbol} skipped: no prices between {options.get('start')} and {options.get('end')}", stacklevel=2)
        if full:
            found.append(calendar.at(out, options.get("interval")))
    except Exception:  # noqa: BLE001  an unreadable file is passed over symbol by symbol
        own, found = set(), []
    for symbol in (s for s in symbols if s not in own):
        try:
            found.append(load(spark, symbol, root, **options))
        except (ValueError, FileNotFoundError) as error:
            warnings.warn(f"{symbol} skipped: {error}", stacklevel=2)
    if not found:
        raise RuntimeError(f"no symbol of {names} could be loaded")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """Parquet sink; returns the path."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def read_results(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """A written results table from a date on."""
    return trimmed(spark.read.parquet(path), start)
