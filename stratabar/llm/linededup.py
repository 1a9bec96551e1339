"""Line dedup by an exact set-similarity join.

A line is its distinct lower-cased words, ``[^\\x20\\x09-\\x0D]+``. A line is
removed if an earlier line (by doc_id, then line number) is equal to it or has
a Jaccard similarity of ``LEAST`` or more with it; whether the earlier one was
itself removed does not matter, so the result does not depend on any order of
work. Lines without words stay.

Equal lines, by their whole normal texts, collapse first: the earliest of each
text stands for all, so a line that a third of all documents hold is one row
from then on. Each remaining line is a sorted set of word hashes of 48 bits.
Words are ordered by rarity, from counts of all words in hash buckets (a table
of fixed size). A line puts its rarest words into the join: as many as the
prefix filter needs on one side, and fewer, as the longer prefix belongs to the
longer line, on the other. Lines meet where they share such a word, their sizes
allow the similarity (length filter), so do the words left after the shared one
(positional filter), and parity signatures of 64 or 128 bits differ in no more
bits than the sets may differ in words. Candidates are verified on whole sets.

Before that join, lines that share two extreme word hashes meet the earliest
line that has the same two, and those it settles no longer look for a partner:
of a large group of near-equal lines a few still do, in place of all pairs.

DataFrame operations only. Defined results: a null text counts as empty; texts
of any length are cut whole; rows are told apart by a row id, so repeated and
null doc_ids are rows of their own, null before all others and rows of equal
ids in any one order; other columns pass through ``clean``; an empty table
gives an empty result.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch, setting, with_rid

LEAST = 0.8
#: White space within lines, besides the space.
WHITE = "\t\x0b\x0c\r"
#: Buckets of the rarity table, a power of two.
BUCKETS = 1 << 18
#: How many groups, as a power of two, Spark's fast hash map of an aggregate holds; 16 by itself, beyond which it is of no use.
TWO_LEVELS = "spark.sql.codegen.aggregate.map.twolevel.enabled"
FAST = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Bits of a word's hash.
BITS = 48
#: Lines of more words have signatures of 128 bits.
SHORT = 76
#: Most line ids that are broadcast, 8 bytes each.
SENT = 1_000_000
#: Shares of the keys that are joined one after another, so that shuffles on disk stay small.
PASSES = 2
#: For tables of hashes and ids, where a dictionary gains nothing.
PLAIN = {"parquet.enable.dictionary": "false", "parquet.size.statistics.enabled": "false"}
#: Hashes get little smaller by more effort.
QUICK = {"parquet.compression.codec.zstd.level": "1"}
#: Writes an array as a repeated field, without a group around each element.
LISTS = "spark.sql.parquet.writeLegacyFormat"
#: Extreme hashes of a line by their places in its sorted ones, and pairs of them by which it meets the earliest like line.
ENDS = {"e1": 1, "e2": 2, "e3": -2, "e4": -1}
EXTREMES = (("e1", "e4"), ("e2", "e3"), ("e1", "e2"), ("e4", "e3"))


def normal(text: Column) -> Column:
    """Lower-cased, with spaces for other white space within lines."""
    # bytes are looked through for each, which takes less than a pattern
    some = reduce(operator.or_, (F.contains(text, F.lit(c)) for c in WHITE))
    return F.when(some, F.translate(F.lower(text), WHITE, " " * len(WHITE))).otherwise(F.lower(text))


def lines_of(rows: DataFrame, text: str) -> DataFrame:
    """(__rid, line, t): the normal text of every line with a word."""
    texts = rows.select("__rid", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).select("__rid", normal(F.col("t")).alias("t"))
    return texts.select("__rid", F.posexplode(F.split("t", "\n", -1)).alias("line", "t")).withColumn("t", F.trim("t")).where("t <> ''")


def word_hash(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit((1 << BITS) - 1))


def bit(k: Column) -> Column:
    """The signature bit of a word's hash; a shift of a long takes its distance mod 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(k, 32).cast("int"))


def parity(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k)))


def places(rows: DataFrame) -> str:
    """The type of the lines' ids: long where row ids leave 31 bits for a line's number, else a decimal."""
    low, high = rows.agg(F.min("__rid"), F.max("__rid")).first()
    return "bigint" if low is None or -(1 << 32) <= low and high < 1 << 32 else "decimal(38,0)"


def parts(kind: str) -> tuple[Column, Column]:
    """Row id and line number of an id."""
    if kind == "bigint":
        return F.shiftright("id", 31), F.col("id").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    line = F.pmod("id", F.lit(1 << 31).cast(kind))
    return ((F.col("id") - line) / F.lit(1 << 31)).cast("long"), line.cast("int")


def sets(lines: DataFrame, kind: str) -> DataFrame:
    """(id, n, h, s1, s2, e1, e2, e3, e4) of the earliest line of each text: its place among all lines, size, sorted hashes, signature and extreme hashes.

    Two sets differ in as many words as the bits in which their signatures
    differ, or more; s1 and s2 are the two halves of long lines, and s1 the
    exclusive or of both for others. e1 to e4 are the hashes at ``ENDS``, null
    where there are too few, so that whole sets are not read for them.
    """
    place = F.col("__rid").cast(kind) * F.lit(1 << 31) + F.col("line")
    first = lines.select("t", place.cast(kind).alias("id")).groupBy("t").agg(F.min("id").alias("id"))
    keys = F.array_remove(F.array_distinct(F.transform(F.split("t", " "), word_hash)), word_hash(F.lit("")))
    hashed = first.select("id", F.sort_array(keys).alias("h"))
    ends = [F.try_element_at("h", F.lit(at)).alias(e) for e, at in ENDS.items()]
    folded = hashed.select("id", F.size("h").alias("n"), "h", parity(F.col("h")).alias("s"), *ends)
    half = F.when(F.col("n") > SHORT, parity(F.filter("h", lambda k: F.shiftright(k, 38).bitwiseAND(F.lit(1)) == 1))).otherwise(F.lit(0).cast("long"))
    split = folded.select("id", "n", "h", "s", half.alias("s2"), *ENDS)
    return split.select("id", "n", "h", F.col("s").bitwiseXOR(F.col("s2")).alias("s1"), "s2", *ENDS)


def ranks(known: DataFrame, scratch: Scratch) -> Column:
    """Rarity ranks (four a doubling of the count) of BUCKETS hash buckets of words, above the bits of a hash: one array, as a scalar subquery."""
    bucket = F.col("k").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")
    counts = known.select(F.explode("h").alias("k")).groupBy(bucket).agg(F.count("*").alias("n"))
    every = counts.union(known.sparkSession.range(BUCKETS).select(F.col("id").cast("int"), F.lit(0).cast("long"))).groupBy("b").agg(F.floor(4 * F.log2(1 + F.sum("n"))).cast("tinyint").alias("r"))
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    pieces = every.groupBy(F.shiftright("b", 9).alias("g")).agg(in_order("b", "r").alias("r"))  # 512 entries each
    table = pieces.agg(F.transform(F.flatten(in_order("g", "r")), lambda r: F.shiftleft(r.cast("long"), BITS)).alias("r"))
    with setting(known.sparkSession, FAST, str(BUCKETS.bit_length())):
        return scratch.keep("ranks", table).scalar()


def need(total: Column, least: float) -> Column:
    """Least number of words shared by two sets of that many together."""
    return F.ceil(F.lit(least / (1 + least)) * total - F.lit(1e-6))


def sized(xn: Column, yn: Column, least: float) -> Column:
    return F.least(xn, yn) >= F.lit(least) * F.greatest(xn, yn) - F.lit(1e-6)


def near(x: str, y: str, least: float) -> Column:
    """Whether sizes and signatures allow the similarity."""
    c = lambda s: F.col(f"{x}{s}"), lambda s: F.col(f"{y}{s}")
    (a, b), total = c, c[0]("n") + c[1]("n")
    folded = F.bit_count(a("s1").bitwiseXOR(a("s2")).bitwiseXOR(b("s1")).bitwiseXOR(b("s2")))
    whole = F.bit_count(a("s1").bitwiseXOR(b("s1"))) + F.bit_count(a("s2").bitwiseXOR(b("s2")))
    differ = F.when((a("n") <= SHORT) | (b("n") <= SHORT), folded).otherwise(whole)
    return sized(a("n"), b("n"), least) & (differ <= total - 2 * need(total, least))


def some(table: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on id; ids go to every executor while they are few, else both sides are shuffled."""
    return table.join(F.broadcast(ids) if ids.count() <= SENT else ids, "id", how)


def verified(pairs: DataFrame, known: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(id) of the later line of each pair (x, y) whose similarity holds, by whole sets of hashes."""
    ids = scratch.keep("ids", pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
    held = scratch.keep("held", some(known.select("id", "n", "h"), ids, "left_semi"))
    side = lambda p: held.select(F.col("id").alias(p), F.col("n").alias(f"{p}n"), F.col("h").alias(f"{p}h"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("c", F.size(F.array_intersect("xh", "yh")))
    alike = both.where(F.col("c") >= F.lit(least) * (F.col("xn") + F.col("yn") - F.col("c")) - F.lit(1e-9))
    return alike.select(F.greatest("x", "y").alias("id")).distinct()


def settled(known: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(id) of lines like the earliest line that has the same two extreme hashes."""
    ends = [F.xxhash64(F.lit(i), *pair) for i, pair in enumerate(EXTREMES)]
    met = known.select("id", "n", "s1", "s2", F.explode(F.array(*ends)).alias("k"))
    # ids alone are compared, which takes no sort; what else the filter asks of the earliest lines is joined to those that lead others.
    # A key has one earliest line, and a line four keys at most, so these hash tables stay even
    first = met.groupBy("k").agg(F.min("id").alias("fid"), F.max("id").alias("last")).where("fid < last").select("k", "fid")
    first = scratch.keep("first", first.hint("shuffle_hash").join(known.select(F.col("id").alias("fid"), *(F.col(c).alias(f"f{c}") for c in ("n", "s1", "s2"))), "fid"), **PLAIN)
    x = met.select("k", F.col("id").alias("xid"), *(F.col(c).alias(f"x{c}") for c in ("n", "s1", "s2")))
    pairs = x.join(first.hint("shuffle_hash"), "k").where((F.col("xid") != F.col("fid")) & near("x", "f", least))
    pairs = scratch.keep("led", pairs.select(F.col("xid").alias("x"), F.col("fid").alias("y")).distinct())
    return verified(pairs, known, least, scratch)


def joined(prefixes: DataFrame, least: float, part: int) -> DataFrame:
    """(x, y) of lines that share a word of their prefixes and pass all filters, for one share of the keys.

    Of two open lines the longer one (the later id, if both are as long) brings its
    whole prefix, and the shorter one the few words that suffice then; with a
    settled line, both bring whole prefixes.
    """
    few = F.col("n") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - F.lit(1e-6)) + 1
    at = F.posexplode("p").alias("i", "key")
    here = F.pmod(F.shiftright("key", 20), F.lit(PASSES)) == part
    key = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)).alias("key")
    # size, place and state are one long, as millions of these rows are shuffled and sorted
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).bitwiseOR(F.col("open").cast("long")).alias("m")
    side = lambda rows, p: rows.select("id", "n", "s1", "s2", "open", at).where(here).select(key, *(c.alias(f"{p}{n}") for n, c in (("id", F.col("id")), ("m", packed), ("s1", F.col("s1")), ("s2", F.col("s2")))))
    shorter = prefixes.withColumn("p", F.when(F.col("open"), F.slice("p", F.lit(1), few.cast("int"))).otherwise(F.col("p")))
    both = side(prefixes.where("open"), "x").join(side(shorter, "y"), "key")
    place = lambda m: F.shiftright(F.col(m).bitwiseAND(F.lit((1 << 32) - 1)), 1)
    both = both.withColumns({"xn": F.shiftright("xm", 32), "yn": F.shiftright("ym", 32), "xi": place("xm"), "yi": place("ym"), "yopen": F.col("ym").bitwiseAND(F.lit(1).cast("long")) == 1})
    order = (F.col("yn") < F.col("xn")) | ((F.col("yn") == F.col("xn")) & (F.col("yid") < F.col("xid"))) | ~F.col("yopen")
    rest = F.least(F.col("xn") - F.col("xi"), F.col("yn") - F.col("yi")) >= need(F.col("xn") + F.col("yn"), least)
    # cheapest first: four in five of those that share a word differ too much in size
    return both.where(order & near("x", "y", least) & rest).select(F.col("xid").alias("x"), F.col("yid").alias("y")).distinct()


def kept_lines(spark: SparkSession, docs: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``docs`` with a row id ``__rid``, and (__rid, __kept): the numbers, from nought, of the lines with words that stay."""
    scratch = Scratch(spark, "lines")
    rows = with_rid(docs, key, scratch)
    kind = places(rows)
    # lines are nearly all distinct, and the map before that of Spark's aggregates takes a second hash of each text, byte by byte
    with setting(spark, TWO_LEVELS, "false"), setting(spark, LISTS, "true"):
        known = scratch.keep("sets", sets(lines_of(rows, text), kind), compression="zstd", **QUICK, **PLAIN)
    gone = scratch.keep("settled", settled(known, least, scratch))
    scratch.drop_but("rows", "sets", "settled")
    rank = ranks(known, scratch)
    # never null, or the sort would be one of objects
    ranked = F.sort_array(F.transform("h", lambda k: F.coalesce(F.get("rank", k.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long")).bitwiseOR(k)))
    prefix = F.slice(ranked, F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-6)) + 1).cast("int"))
    marked = gone.select("id", F.lit(False).alias("open"))
    # a subquery may not stand inside the lambda by itself, but as a column that is used once it is put there
    marked = known.join(F.broadcast(marked) if gone.count() <= SENT else marked, "id", "left").withColumn("rank", rank)
    with setting(spark, LISTS, "true"):
        prefixes = scratch.keep("prefixes", marked.select("id", "n", "s1", "s2", F.coalesce("open", F.lit(True)).alias("open"), prefix.alias("p")), **PLAIN)
    pairs = None
    for part in range(PASSES):
        found = scratch.keep("pairs", joined(prefixes, least, part), **PLAIN)
        pairs = found if pairs is None else pairs.union(found)
    gone = scratch.keep("gone", gone.union(verified(pairs.distinct(), known, least, scratch)).distinct())
    rid, line = parts(kind)
    left = some(known.select("id"), gone, "left_anti").select(rid.alias("__rid"), line.alias("line"))
    kept = scratch.keep("kept", left.groupBy("__rid").agg(F.collect_list("line").alias("__kept")))  # at most a document's lines
    scratch.drop_but("kept", "rows")
    return rows, kept


def cut(text: str) -> Column:
    """The lines of a text; a null text has one, the empty one."""
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def numbers(parts: str) -> Column:
    """Numbers of the lines that have a word."""
    return F.array_compact(F.transform(parts, lambda x, i: F.when(F.ltrim(x, F.lit(" " + WHITE)) != "", i)))


def digest(rows: DataFrame, kept: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): removed holds the line numbers, from nought, comma-joined."""
    parts = rows.select("__rid", F.col(key).cast("long").alias("doc_id"), cut(text).alias("parts"))
    sizes = parts.select("__rid", "doc_id", F.size("parts").cast("long").alias("n_lines"), numbers("parts").alias("all"))
    gone = F.array_except("all", F.coalesce("__kept", F.array().cast("array<int>")))
    out = sizes.join(kept, "__rid", "left").select("doc_id", "n_lines", gone.alias("gone"))
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed"))


def clean(rows: DataFrame, kept: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without the removed lines and the row id; all other columns stay, a null text too."""
    gone = F.array_except(numbers("__parts"), F.coalesce("__kept", F.array().cast("array<int>")))
    # gone is in order, so a cursor over it would do; a map keeps the look-up constant in a document's lines
    out = rows.join(kept, "__rid", "left").withColumn("__parts", cut(text)).withColumn("__gone", gone)
    flags = F.map_from_arrays(F.col("__gone"), F.array_repeat(F.lit(True), F.size("__gone")))
    left = F.array_join(F.array_compact(F.transform("__parts", lambda x, i: F.when(F.element_at(flags, i).isNull(), x))), "\n")
    names = [c for c in rows.columns if c != "__rid"]
    return out.select(*(F.when(F.size("__gone") > 0, left).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in names))


def oracle(least: float = LEAST) -> str:
    """The query in DuckDB SQL: equal sets of words first, then a prefix join and whole sets."""
    return f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, unnest(range(len(p)))::INTEGER AS line, unnest(p) AS raw FROM t),
w AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(raw), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY doc_id, line) AS copy, row_number() OVER (ORDER BY doc_id, line) AS id FROM w WHERE len(ws) > 0),
r AS (SELECT id, doc_id, line, ws, len(ws) AS n FROM o WHERE copy = 1),
k AS (SELECT id, n, unnest(ws) AS word FROM r),
f AS (SELECT word, count(*) AS df FROM k GROUP BY word),
x AS (SELECT id, n, word FROM (SELECT k.*, row_number() OVER (PARTITION BY id ORDER BY df, word) AS pos FROM k JOIN f USING (word)) WHERE pos <= n - ceil({least} * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.word = b.word AND a.id > b.id AND least(a.n, b.n) >= {least} * greatest(a.n, b.n) - 1e-9),
v AS (SELECT p.id, len(list_intersect(p.ws, q.ws)) AS m, p.n + q.n AS s FROM c JOIN r p ON p.id = c.a JOIN r q ON q.id = c.b),
g AS (SELECT doc_id, line FROM o WHERE copy > 1 UNION SELECT doc_id, line FROM r WHERE id IN (SELECT id FROM v WHERE m >= {least} * (s - m) - 1e-9)),
d AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed FROM g GROUP BY doc_id)
SELECT t.doc_id, len(p)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM t LEFT JOIN d ON d.doc_id = t.doc_id
"""
