"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up to cells of (source, language, topic). The cells'
weights are raked to the three target marginals in turn until each is within
``CLOSE`` of its target, or no longer comes nearer; a cell's factor is its weight against its tokens. Documents are then sampled by
probabilities in proportion to the factor, calibrated so that the expected
tokens kept are ``rate`` of all: probabilities that reach one are held there
and the others raised until no more reach one. The draw is a hash of the key, so the
sample is the same on every run.

Targets of a dimension are the tempered shares share ** power; given targets
may be passed instead, as DataFrames (value, share). All of it is DataFrame
operations: marginals are sums with partial aggregation joined back to cells,
and only single rows of totals reach the driver.

Defined results: a null source, language or text counts as empty; a document
without words has no weight and probability one (it costs no tokens); repeated
rows each count; an empty table gives an empty result; a marginal that no cell
can reach stays as near as raking brings it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch

#: Largest relative error of a marginal at which raking ends.
CLOSE = 1e-9
#: Rounds between two looks at the error, and most cells that are raked in one partition.
BATCH = 6
FEW = 20_000
#: Rounds of raking and of calibration that the SQL unrolls, more than its tables take.
SQL_ROUNDS = 24
SQL_LEVELS = 10
RATE = 0.6
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
DIMS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, tokens: Column) -> Column:
    """A structural topic: tables, settings, contacts, and prose by length."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit(" = ")) | F.contains(text, F.lit("{")), "settings")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(tokens < 64, "note")
        .when(tokens < 512, "prose")
        .otherwise("long")
    )


def counted(docs: DataFrame, topic: Column | None = None, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens), nulls as empty, and the columns to keep."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", *keep, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), text.alias("__t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), *([] if topic is None else [topic.alias("topic")]))
    return base.select("doc_id", *keep, "source", "lang", (topic_of(F.col("__t"), F.col("n_tokens")) if topic is None else F.coalesce(F.col("topic").cast("string"), F.lit(""))).alias("topic"), "n_tokens")


def rake(cells: DataFrame, few: bool) -> DataFrame:
    """One round over the three marginals; ``few`` cells lie in one partition, where sums need no exchange."""
    for dim in DIMS:
        if few:
            have = F.sum("w").over(Window.partitionBy(dim))
            cells = cells.withColumn("w", F.when(have > 0, F.col("w") * F.col(f"{dim}_share") / have).otherwise(0.0))
            continue
        have = cells.groupBy(dim).agg(F.sum("w").alias("have"))
        cells = cells.join(have, dim).withColumn("w", F.when(F.col("have") > 0, F.col("w") * F.col(f"{dim}_share") / F.col("have")).otherwise(0.0)).drop("have")
    return cells


def off(cells: DataFrame, dim: str) -> float:
    """Largest relative error of a marginal against its target."""
    have = cells.groupBy(dim).agg(F.sum("w").alias("have"), F.first(f"{dim}_share").alias("share"))
    return have.agg(F.coalesce(F.max(F.abs(F.try_divide("have", "share") - 1)), F.lit(0.0))).first()[0]


def probabilities(spark: SparkSession, rows: DataFrame, rate: float = RATE, close: float = CLOSE, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Cells with columns source, lang, topic, n, f, p from ``counted`` rows."""
    scratch = scratch or Scratch(spark, "mixing")
    powers = powers or POWERS
    cells = scratch.keep("cells", rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n")).where("n > 0"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return cells.select(*DIMS, "n", F.lit(0.0).alias("f"), F.lit(1.0).alias("p"))
    aims = {}
    for dim in DIMS:
        if targets and dim in targets:
            aims[dim] = targets[dim].select(F.col("value").alias(dim), "share")
            continue
        raised = cells.groupBy(dim).agg(F.pow(F.sum("n") / F.lit(float(total)), F.lit(powers[dim])).alias("r"))
        whole = raised.agg(F.sum("r")).first()[0]
        aims[dim] = scratch.keep(f"aim-{dim}", raised.select(dim, (F.col("r") / F.lit(whole)).alias("share")))
    now = cells.withColumn("w", F.col("n") / F.lit(float(total)))
    for dim in DIMS:
        now = now.join(aims[dim].withColumnRenamed("share", f"{dim}_share"), dim, "left").fillna(0.0, [f"{dim}_share"])
    few = cells.count() <= FEW
    k, apart = 0, float("inf")
    while True:
        now = now.repartition(1) if few else now
        for _ in range(BATCH):
            # a join of cells with their own sums doubles the plan, so each round is written
            now = rake(now, few) if few else scratch.keep(f"joined{k}", rake(now, few))
        now, k, before = scratch.keep(f"round{k + 1}", now), k + 1, apart
        scratch.drop(f"round{k - 1}", f"joined{k - 1}")
        apart = max(off(now, dim) for dim in DIMS)
        if apart <= close or apart > 0.99 * before:  # reached, or targets that these cells cannot reach together
            break
    now = now.withColumn("f", F.col("w") * F.lit(float(total)) / F.col("n"))
    level = rate
    before = None
    while level != before:  # ends, as the cells held at one only grow in number
        before = level
        held = F.col("f") * level >= 1
        full, rest = now.agg(F.sum(F.when(held, F.col("n")).otherwise(0)), F.sum(F.when(held, 0.0).otherwise(F.col("n") * F.col("f")))).first()
        level = (rate * total - full) / rest if rest else level
    return now.select(*DIMS, "n", "f", F.least(F.lit(1.0), F.col("f") * F.lit(level)).alias("p"))


def draw(key: Column) -> Column:
    """A number in [0, 1) from the key's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample(spark: SparkSession, docs: DataFrame, rate: float = RATE, topic: Column | None = None, keep: list[str] | tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, n_tokens, topic, factor, probability, kept) of every document, and the columns to keep."""
    scratch = Scratch(spark, "mixing")
    rows = scratch.keep("rows", counted(docs, topic, keep))
    cells = scratch.keep("rows", probabilities(spark, rows, rate, scratch=scratch, **options).select(*DIMS, "f", "p"))
    joined = rows.join(cells, list(DIMS), "left")
    p = F.coalesce("p", F.lit(1.0))
    scratch.drop_but("rows")
    return joined.select("doc_id", *keep, "n_tokens", "topic", F.coalesce("f", F.lit(0.0)).alias("factor"), p.alias("probability"), (draw(F.col("doc_id")) < p).alias("kept"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    parts = ["""
r AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, ' = ') OR contains(t, '{') THEN 'settings'
  WHEN contains(t, '@') THEN 'contact' WHEN n_tokens < 64 THEN 'note' WHEN n_tokens < 512 THEN 'prose' ELSE 'long' END AS topic FROM r),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
tot AS (SELECT sum(n) AS total FROM c),
s0 AS (SELECT c.*, n / total AS w FROM c, tot)"""]
    for dim, power in POWERS.items():
        parts.append(f"a_{dim} AS (SELECT {dim}, r / sum(r) OVER () AS share FROM (SELECT {dim}, pow(sum(n) / any_value(total), {power}) AS r FROM c, tot GROUP BY {dim}))")
    k = 0
    for _ in range(SQL_ROUNDS):
        for dim in DIMS:
            parts.append(f"s{k + 1} AS MATERIALIZED (SELECT source, lang, topic, n, w * share / sum(w) OVER (PARTITION BY {dim}) AS w FROM s{k} JOIN a_{dim} USING ({dim}))")
            k += 1
    parts.append(f"g AS MATERIALIZED (SELECT s{k}.*, w * total / n AS f, total FROM s{k}, tot), l0 AS (SELECT {RATE}::DOUBLE AS level)")
    for i in range(SQL_LEVELS):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT ({RATE} * any_value(total) - sum(CASE WHEN f * level >= 1 THEN n ELSE 0 END)) / sum(CASE WHEN f * level >= 1 THEN 0 ELSE n * f END) AS level FROM g, l{i})")
    parts.append(f"p AS (SELECT source, lang, topic, f, least(1.0, f * level) AS p FROM g, l{SQL_LEVELS})")
    return "WITH " + ",\n".join(x.strip() for x in parts) + """
SELECT doc_id, n_tokens, topic, round(coalesce(f, 0), 6) AS factor, round(coalesce(p, 1), 6) AS probability,
  ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT / 4294967296.0 < coalesce(p, 1) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)
"""
