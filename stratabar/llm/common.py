"""Shared pieces: scratch tables, table reading, folds and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}
#: Lets Spark delete a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop)
    is a temporary folder made and set, once an application; a cluster that
    names none is refused, as its machines would each write to their own disk.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if root:
        return root
    # every running context has a master in its settings
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master") or "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="stratabar-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_root(spark).rstrip('/')}/stratabar/{tag}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        self.made = 0

    def keep(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        """Write ``df`` under ``name`` and return a frame that reads it again; the shuffle files of the write go with it."""
        self.made += 1
        path = f"{self.base}/{name}-{self.made}"
        with setting(self.spark, CLEANUP, "true"):
            df.write.options(**options).parquet(path)
        if not self.paths:
            self._file(self.base, lambda fs, p: fs.deleteOnExit(p))
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _file(self, path: str, act) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        act(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p)

    def drop(self, *names: str) -> None:
        """Delete tables no later read needs."""
        for name in names:
            for path in self.paths.pop(name, ()):
                self._file(path, lambda fs, p: fs.delete(p, True))

    def drop_but(self, *names: str) -> None:
        """Delete all tables but those; what stays goes when the driver's JVM ends."""
        self.drop(*(set(self.paths) - {*names}))


def with_rid(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``docs`` with a long ``__rid`` that tells rows apart and is in the order of ``key``, nulls first.

    It is the key itself where that is unique; else the rows are sorted,
    numbered and written, so that a later read finds the same numbers.
    """
    k = F.col(key).cast("long")
    n, some, each = docs.agg(F.count("*"), F.count(k), F.count_distinct(k)).first()
    if n == some == each:
        return docs.withColumn("__rid", k)
    return scratch.keep("rows", docs.orderBy(k).withColumn("__rid", F.monotonically_increasing_id()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def components(spark: SparkSession, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges(u, v)``: one row (node, component) per node in an edge.

    ``component`` is the smallest node reachable. Alternates large-star and
    small-star steps (Kiveris et al. 2014); each is a minimum with partial
    aggregation and an equi-join, so a node with very many links is never
    gathered in one task. Each round is written to the shared folder.
    """
    scratch = Scratch(spark, tag)
    kind = edges.schema["u"].dataType
    cur = scratch.keep("r", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = cur.union(cur.select("v", "u"))
        # written minima, so that both sides of each join are dealt anew and Spark can split a node with very many links
        low = scratch.keep("low", both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        # every node keeps a link to its own minimum so none is lost
        own = low.where("u <> lo").select("u", F.col("lo").alias("v"))
        step = scratch.keep("step", large.union(own).where("u <> v").distinct())
        low2 = scratch.keep("low", step.groupBy("u").agg(F.min("v").alias("lo")))
        small = step.join(low2, "u").select(F.col("v").alias("u"), F.col("lo").alias("v")).union(low2.select("u", F.col("lo").alias("v")))
        new = scratch.keep("n", small.where("u <> v").distinct())
        stat = new.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop("r", "low", "step")
        scratch.paths["r"] = scratch.paths.pop("n")
        cur = new
        # a star forest: each node once on the left, and unchanged by a round
        if stat[0] == stat[1] and (stat[0] == 0 or tuple(stat) == before):
            break
        before = tuple(stat)
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").cast(kind).alias("node"), F.col("v").alias("component")).union(roots)


def forest(pairs, n: int):
    """Union-find over local indices: (child, root) edges of a spanning forest, roots being smallest."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(i, r) for i in range(n) if (r := find(i)) != i]
