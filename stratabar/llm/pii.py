"""Personal data by plain patterns and bootstrapped contextual extraction.

Four plain kinds (email, ip, card, phone) are found by patterns with checks.
From them the method learns: every token that could be an identifier (a word
with a digit or an at sign) and every run of such tokens (an identifier written
in groups, of capitals too) stands in a context, the word before it or the word
after it. Plain finds are the seeds; contexts are patterns, tokens instances.
Round by round, until no instance is new, a pattern is scored by the share of
trusted instances among the distinct instances it extracts, of which at least
``SUPPORT`` must be trusted, and an instance is trusted once patterns of high
confidence extract it and it has an at sign, six digits, or a shape (digits
and letters) that occurs, but for a fifth, in such patterns only. Words with
neither digit nor at sign are extracted at the end, by patterns that are as
confident over all the words they extract; they teach no further pattern.
Instances that end up trusted are added as spans of
kind ``context``; plain spans always stay.

DataFrame operations only; what the rounds join are distinct (pattern,
instance) edges with partial counts. The texts are read again for plain words.

Defined results: a null text counts as empty; texts are searched whole; the
patterns are written so that no text makes them slow or deep; repeated rows
are each searched; a table without seeds adds nothing; other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch, with_rid

KINDS = ("email", "ip", "card", "phone")
# The plain patterns, with possessive repeats; a match may begin at the end of the last one (\G) or where no such character stands before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BLANKS = "\t\n\x0b\x0c\r"
CANDIDATE = r"(?<![^\x20])[^\x200-9@]*+[0-9@][^\x20]*+"
#: Marks around a candidate that are not part of it.
OPENING, CLOSING = "([{<\"'", ".,;:!?)]}>\"'"
#: Neighbouring candidates one blank apart, with groups of capitals between them: an identifier written in groups.
RUN = r"(?<![^\x20])[^\x200-9@]*+[0-9@][^\x20]*+(?:\x20(?:[^\x200-9@]*+[0-9@][^\x20]*+|[A-Z]++(?=\x20[^\x200-9@]*+[0-9@])))++"
CONFIDENT = 0.8
SUPPORT = 5
PIECE = 256
#: Most patterns or words that are broadcast.
SENT = 200_000


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & (F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p.cast("decimal(38,0)")).otherwise(F.lit(999)) <= 255))
    n = F.length(digits(found))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


MATCH = "array<struct<s:int,e:int,x:string,b:string,a:string>>"


def running(lengths: Column) -> Column:
    """Running sums of an array of integers.

    A fold copies what it has at every step, so it goes over pieces of ``PIECE``
    entries and over the pieces' totals, in place of the whole array.
    """
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def add(acc, n):
        at = acc["at"] + n
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / PIECE).cast("int"), F.lit(0))), lambda k: F.aggregate(F.slice(lengths, k * PIECE + 1, PIECE), zero, add))
    # bound to a variable, so that the pieces are worked out once
    bound = lambda made: F.flatten(F.zip_with(made, F.aggregate(F.transform(made, lambda m: m["at"]), zero, add)["out"], lambda m, end: F.transform(m["out"], lambda x: x + end - m["at"])))
    return F.when(F.size(lengths) > 0, F.get(F.transform(F.array(pieces), bound), F.lit(0))).otherwise(none)


def matches(text: Column, pattern: str, keep) -> Column:
    """Array of (s, e, x, b, a): matches that ``keep`` passes, their places in code points, and the words around them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(both):
        f, g = both["f"], both["g"]
        ends = running(F.zip_with(f, g, lambda x, y: F.length(y).cast("long") + F.coalesce(F.length(x), F.lit(0))))
        # the gap after the last match has no match: it is filtered out
        rows = F.zip_with(F.zip_with(f, g, lambda x, y: F.struct(x.alias("x"), y.alias("g"))), F.zip_with(F.slice(g, 2, 1 << 30), ends, lambda h, e: F.struct(h.alias("h"), e.cast("int").alias("e"))), lambda m, n: F.struct(m["x"].alias("x"), m["g"].alias("g"), n["h"].alias("h"), n["e"].alias("e")))
        kept = F.filter(rows, lambda m: F.when(m["x"].isNull(), False).otherwise(keep(m["x"])))
        return F.transform(kept, lambda m: F.struct((m["e"] - F.length(m["x"])).alias("s"), m["e"].alias("e"), m["x"].alias("x"), F.substring_index(F.rtrim(m["g"]), " ", -1).alias("b"), F.substring_index(F.ltrim(m["h"]), " ", 1).alias("a")))

    return F.get(F.transform(F.array(F.struct(found.alias("f"), gaps.alias("g"))), placed), F.lit(0)).cast(MATCH)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(rid, doc_id, email, ip, card, phone, cand, run): arrays of matches; one narrow pass."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rid = F.col("__rid") if "__rid" in docs.columns else F.monotonically_increasing_id()
    base = docs.select(rid.alias("rid"), F.col(key).cast("long").alias("doc_id"), t.alias("t"))
    none = F.array().cast(MATCH)
    some = F.col("t").rlike("[0-9@]")
    hint = lambda kind: some & F.contains("t", F.lit(HINTS[kind])) if HINTS[kind] else some
    spaced = F.translate("t", BLANKS, "     ")
    found = [F.when(hint(k), matches(F.col("t"), PATTERNS[k], lambda x, k=k: passes(k, x))).otherwise(none).alias(k) for k in KINDS]
    near = [F.when(some, matches(spaced, p, lambda x: F.lit(True))).otherwise(none).alias(k) for k, p in (("cand", CANDIDATE), ("run", RUN))]
    return base.select("rid", "doc_id", *found, *near)


def bare(x: Column) -> Column:
    return F.rtrim(F.ltrim(x, F.lit(OPENING)), F.lit(CLOSING))


def candidates(scanned: DataFrame) -> DataFrame:
    """(rid, s, e, instance, run, part, seed, b, a) of every candidate, bare of the marks around it; ``part`` of a run or not.

    A candidate meets a span if, of those that start before its end, one ends
    behind its start: a running maximum over a text's places, in order.
    """
    marked = lambda k, tag: F.transform(k, lambda m: F.struct(F.lit(tag).alias("tag"), m.alias("m")))
    every = F.concat(marked("cand", "cand"), marked("run", "run"), *(marked(k, "plain") for k in KINDS))
    c = scanned.where("size(cand) > 0").select("rid", F.explode(every).alias("x")).select("rid", "x.tag", "x.m.*")
    opened = F.ltrim("x", F.lit(OPENING))
    plain = F.col("tag") == "plain"
    c = c.select("rid", "tag", F.when(plain, F.col("s")).otherwise(F.col("e") - F.length(opened)).alias("s"), "e", F.when(plain, F.col("x")).otherwise(bare(F.col("x"))).alias("x"), F.lower("b").alias("b"), F.lower("a").alias("a"), F.col("s").alias("from"))
    c = c.where("x <> ''").withColumn("to", F.when(plain, F.col("e")).otherwise(F.col("s") + F.length("x")))
    # a span takes part as a run or as a plain find, and a candidate, be it single or a run, asks
    spans = F.array(F.struct(F.when(plain, "plain").alias("is"), F.when(plain, F.col("s")).otherwise(F.col("to")).alias("at"), plain.alias("span")), F.struct(F.when(F.col("tag") == "run", "run").alias("is"), F.col("from").alias("at"), F.lit(True).alias("span")))
    asks = c.select("*", F.explode(F.filter(spans, lambda x: x["is"].isNotNull() | ~x["span"])).alias("q")).select("*", "q.*")
    before = Window.partitionBy("rid").orderBy("at", F.col("span").asc()).rowsBetween(Window.unboundedPreceding, 0)
    ends = lambda kind: F.max(F.when(F.col("is") == kind, F.col("e"))).over(before)
    met = asks.select("*", ends("run").alias("run_end"), ends("plain").alias("plain_end")).where("not span")
    meets = lambda end: F.coalesce(F.col(end) > F.col("s"), F.lit(False))
    run = F.col("tag") == "run"
    return met.select("rid", "s", F.col("to").alias("e"), F.lower("x").alias("instance"), run.alias("run"), (~run & meets("run_end")).alias("part"), meets("plain_end").alias("seed"), "b", "a")


def shape(instance: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(instance, "[0-9]", "9"), r"\p{L}", "a")


def bootstrap(spark: SparkSession, cands: DataFrame, scratch: Scratch, confident: float = CONFIDENT, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(instance, trust) of the instances that confident patterns extract, seeds left out; (pattern, t) of the patterns of single tokens that are confident in the end."""
    pattern = F.explode(F.array(F.concat(F.lit("L "), "b"), F.concat(F.lit("R "), "a")))
    edges = cands.where("b <> '' or a <> ''").select(pattern.alias("pattern"), "instance", "run", "part", "seed").where("length(pattern) > 2")
    edges = scratch.keep("edges", edges.groupBy("pattern", "instance", "run").agg(F.max("seed").alias("seed"), F.max("part").alias("part"), F.count("*").alias("n")))
    # an identifier by its form alone; others need a shape that is met in confident patterns only
    formed = F.contains("instance", F.lit("@")) | (F.length(digits(F.col("instance"))) >= 6)
    shapes = scratch.keep("shapes", edges.where(~formed).groupBy("instance").agg(F.max("part").alias("part")).where("not part").select("instance", shape(F.col("instance")).alias("shape")))
    sizes = scratch.keep("sizes", shapes.groupBy("shape").agg(F.count("*").alias("size")))
    trusted = scratch.keep("trusted", edges.where("seed").groupBy("instance").agg(F.lit(1.0).alias("trust"), F.max("seed").alias("seed")))

    def confidence() -> DataFrame:
        known = edges.join(trusted.select("instance", "trust"), "instance", "left")
        scored = known.groupBy("pattern", "run").agg(F.count("*").alias("k"), F.sum(F.coalesce("trust", F.lit(0.0))).alias("t"), F.count("trust").alias("c"))
        return scored.where((F.col("c") >= support) & (F.col("t") / F.col("k") >= confident)).select("pattern", F.col("run").alias("of_runs"), "t", (F.col("t") / F.col("k")).alias("conf"))

    known = trusted.count()
    while True:
        # a pattern learned from single tokens extracts runs too, one learned from runs no single tokens
        good = confidence()
        reached = edges.join(good, "pattern").where("run or not of_runs").groupBy("instance").agg(F.max("conf").alias("trust"), F.max("seed").alias("seed"))
        reached = scratch.keep("reached", reached)
        of = reached.join(shapes.select("instance", "shape"), "instance")
        learned = of.groupBy("shape").agg(F.count("*").alias("met")).join(sizes, "shape").where(F.col("met") / F.col("size") >= confident).select("shape")
        new = reached.where(formed).union(of.join(learned, "shape").select("instance", "trust", "seed"))
        both = trusted.union(new).groupBy("instance").agg(F.max("trust").alias("trust"), F.max("seed").alias("seed"))
        trusted = scratch.keep("trusted", both)
        if (now := trusted.count()) == known:
            break  # trust only grows, so what a further round could learn is known
        known = now
    ends = scratch.keep("ends", confidence().where("not of_runs").select("pattern", "t"))
    return trusted.where("not seed").select("instance", "trust"), ends


def tokens(rows: DataFrame, text: str) -> DataFrame:
    """(rid, ts): the texts' pieces between blanks, some of them empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.select(F.col("__rid").alias("rid"), F.split(F.translate(t, BLANKS, "     "), " ").alias("ts"))


def few(rows: DataFrame) -> DataFrame:
    """For a join with every word of the texts: sent to all executors while it has few rows, so that the words stay where they are."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def plain_words(docs: DataFrame, ends: DataFrame, scratch: Scratch, text: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """(rid, s, e) of words with neither digit nor at sign that confident patterns extract.

    Here a pattern is scored over all words it extracts, not those with digits
    only, and a word must stand in such patterns in most of its places. Most
    patterns extract far too many words for that, so their words are first dealt
    to hash buckets: more filled buckets than a confident pattern may have words
    rule a pattern out, and distinct words are gathered for the others only.
    """
    words = tokens(docs, text).select(F.filter("ts", lambda x: x != "").alias("ws"))
    three = F.transform("ws", lambda x, i: F.struct(F.lower(bare(x)).alias("instance"), F.lower(F.get("ws", i - 1)).alias("b"), F.lower(F.get("ws", i + 1)).alias("a")))
    near = words.select(F.explode(three).alias("w")).select("w.*").where("instance <> ''")
    word = ~F.col("instance").rlike("[0-9@]")
    sides = lambda rows, of: rows.select("instance", F.explode(F.array(F.concat(F.lit("L "), "b"), F.concat(F.lit("R "), "a"))).alias("pattern")).join(few(of), "pattern")
    bucket = F.pmod(F.xxhash64("instance"), F.ceil(F.col("t") * F.lit(2 / confident - 2)).cast("long") + 4)
    filled = sides(near.where(word), ends).select("pattern", "t", bucket.alias("bucket")).distinct().groupBy("pattern", "t").agg(F.count("*").alias("k"))
    ends = scratch.keep("open", filled.where(F.col("t") / (F.col("k") + F.col("t")) >= confident).select("pattern", "t"))
    none = docs.sparkSession.createDataFrame([], "rid long, s int, e int")
    if ends.isEmpty():
        return none
    edges = scratch.keep("word-edges", sides(near, ends.select("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("n")))
    plain = edges.where(word).groupBy("pattern").agg(F.count("*").alias("k"))
    single = edges.where(~word).groupBy("pattern").agg(F.count("*").alias("d"))
    good = ends.join(plain, "pattern").join(single, "pattern").where(F.col("t") / (F.col("k") + F.greatest("d", "t")) >= confident).select("pattern")
    reached = scratch.keep("words", edges.where(word).join(good, "pattern").groupBy("instance").agg(F.max("n").alias("n")))
    if reached.isEmpty():
        return none
    often = near.select("instance").join(few(reached), "instance").groupBy("instance").agg(F.count("*").alias("all"), F.first("n").alias("n"))
    kept = scratch.keep("kept", often.where(F.col("n") / F.col("all") >= confident).select("instance"))
    starts = lambda ts: running(F.transform(ts, lambda x: F.length(x).cast("long") + 1))
    at = tokens(docs, text).select("rid", F.explode(F.zip_with("ts", starts(F.col("ts")), lambda x, end: F.struct(x.alias("x"), end.alias("end")))).alias("w")).select("rid", "w.*").where("x <> ''")
    pieces = at.select("rid", F.lower(bare(F.col("x"))).alias("instance"), (F.col("end") - 1 - F.length(F.ltrim("x", F.lit(OPENING)))).cast("int").alias("s"))
    return pieces.join(few(kept), "instance").select("rid", "s", (F.col("s") + F.length("instance")).alias("e"))


def find(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_context) for every row."""
    scratch = Scratch(spark, "pii")
    # the texts are read more than once: a row must have the same id each time
    docs = with_rid(docs, key, scratch)
    scanned = scratch.keep("scanned", scan(docs, text, key))
    cands = scratch.keep("cands", candidates(scanned))
    new, ends = bootstrap(spark, cands, scratch)
    added = cands.where("not seed").join(new, "instance").select("rid", "s", "e")
    added = added.union(plain_words(docs, ends, scratch, text)).distinct()
    # a span inside another, as a group of a run is, does not count by itself
    before = Window.partitionBy("rid").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("far", F.max("e").over(before)).where("far is null or far < e").select("rid", F.struct("s", "e").alias("m"))
    added = added.groupBy("rid").agg(F.sort_array(F.collect_list("m")).alias("context"))  # at most a document's spans
    show = lambda kind, col: F.transform(col, lambda m: F.concat_ws(":", F.lit(kind), m["s"], m["e"]))
    base = F.concat(*(show(k, F.col(k)) for k in KINDS))
    joined = scanned.join(added, "rid", "left")
    extra = F.coalesce(show("context", F.col("context")), F.array().cast("array<string>"))
    return joined.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.array_join(base, ",").alias("base"),
        F.array_join(F.concat(base, extra), ",").alias("spans"), F.size(extra).cast("long").alias("n_context"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_context")
