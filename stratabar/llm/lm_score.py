"""Language-model scores by context-tree weighting over bytes.

The model (Willems, Shtarkov and Tjalkens 1995) predicts each byte as eight
binary decisions. Every decision keeps, at each context depth from none to
``DEPTH`` bytes, a Krichevsky-Trofimov estimate; a node's weighted probability
is half its own estimate's and half the product of its children's. As block
probabilities depend on counts alone, the tree follows from the counts of
(DEPTH + 1)-byte strings of the training texts, gathered with Spark; the
weights that the training blocks give then mix the estimates of all depths,
and texts are scored with the mixture unchanged. A decision never met in
training has the estimate one half.

A text is its words, A-Z lower-cased, joined by single spaces, then a line
feed as end; the bytes before its start are line feeds. The base score is an
add-one unigram over the same words.

Memory: the tree is worked out in partitions of about ``PART`` byte strings
that share their three nearest bytes; only its top, depths nought to two (at
most 16.8 million decisions), meets on the driver. Strings are looked up in
exact hash tables of at most ``BLOCK``, one pass over the texts a table;
frequent words, at most ``HEAD``, in a broadcast table. Other words, and byte
strings never seen in training, go by equi-joins.

Defined results: a null or empty text is the end alone; a text of any length
is scored whole; repeated rows score alike; other columns do not matter; with
no training rows counts are zero and every estimate is a half.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch, fold, with_rid

DEPTH = 5
#: Bits of a byte string's code; the table below needs 48 at most.
WIDTH = 8 * (DEPTH + 1)
BLOCK = 6_000_000
PART = 400_000
HEAD = 131_072
PAD = b"\n" * DEPTH
HALF = math.log(0.5)
#: Node of each (byte, bit) on the way down the byte's decisions, high bit first, and the bit itself.
BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
NODES = (1 << np.arange(8)) - 1 + (np.arange(256)[:, None] >> np.arange(8, 0, -1))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive values: Stirling's series after shifting by six."""
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - lgamma(zeros + ones + 1.0)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, share of the node's own estimate in it)."""
    total = np.logaddexp(HALF + own, HALF + below)
    return total, np.exp(HALF + own - total)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def portions(column: pa.Array, size: int = 400_000):
    """Lists of a column's texts, of about so many bytes each, a longer text ending its list; only one is in Python at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)) + 1
        yield column.slice(lo, hi - lo).to_pylist()
        lo = hi


def grams(words: list[list[bytes]]) -> np.ndarray:
    """The (DEPTH + 1)-byte strings of the texts as numbers, the predicted byte lowest."""
    parts = [PAD + b" ".join(w) + b"\n" for w in words]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    codes = np.zeros(len(raw) - DEPTH, dtype=np.int64)
    for k in range(DEPTH + 1):
        codes <<= 8
        codes |= raw[k : len(raw) - DEPTH + k]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    keep = np.ones(len(raw), dtype=bool)
    for k in range(DEPTH):
        keep[starts + k] = False
    return codes[keep[DEPTH:]]


def count_batches(batches):
    """(word or null, code or null, n): counts of a task, let go whenever they grow large."""
    names, held = ["word", "code", "n"], Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.nulls(len(held), pa.int64()), pa.array(held.values(), pa.int64())], names=names)

    codes, times, fresh = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def merged():
        new, n = np.unique(np.concatenate(fresh), return_counts=True)
        both, inverse = np.unique(np.concatenate((codes, new)), return_inverse=True)
        return both, np.bincount(inverse, np.concatenate((times, n))).astype(np.int64)

    for batch in batches:
        for texts in portions(batch.column(0)):
            words = [tokens(x) for x in texts]
            for w in words:
                held.update(w)
            held[None] += len(words)  # the end, which no word equals
            if len(held) > 150_000:
                yield out()
                held = Counter()
            fresh.append(grams(words))
            if sum(map(len, fresh)) > 2_000_000:
                codes, times = merged()
                fresh = []
    if fresh:
        codes, times = merged()
    if held:
        yield out()
    yield pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.binary()), pa.array(codes), pa.array(times)], names=names)


def run_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in order once each, and sums of the values over equal keys; keys come in order."""
    if not len(keys):
        return (keys, *values)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[starts], *(np.add.reduceat(v, starts) for v in values))


def strip(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys (context, decision) with the context cut to its ``depth`` nearest bytes."""
    return keys & ((1 << (8 * depth + 8)) - 1)


class Level:
    """Decisions of one depth (and bit): sorted keys (context << 8 | decision), ones, visits, weights."""

    def __init__(self, keys, ones, visits, below=None):
        self.keys, self.chance = keys, (ones + 0.5) / (visits + 1.0)
        own = block_log(visits - ones, ones)
        self.total, self.share = (own, np.ones(len(own))) if below is None else weigh(own, below)

    def find(self, keys) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def deep_levels(codes: np.ndarray, n: np.ndarray) -> dict:
    """{(depth, bit): Level} for depths three and more, from the strings that share nearest bytes."""
    out, below = {}, [None] * 8
    for depth in range(DEPTH, 2, -1):
        cut = codes & ((1 << (8 * depth + 8)) - 1)
        order = np.argsort(cut, kind="stable")
        grams_, times = run_sums(cut[order], n[order].astype(float))
        byte, ctx = grams_ & 255, grams_ >> 8 << 8
        for k in range(8):
            keys, ones, visits = run_sums(ctx | NODES[byte, k], times * BITS[byte, k], times)
            under = None
            if below[k] is not None:
                child = below[k]
                under = np.bincount(np.searchsorted(keys, strip(child.keys, depth)), child.total, minlength=len(keys))
            out[depth, k] = below[k] = Level(keys, ones, visits, under)
            out[depth, k].counts = (ones, visits)
    return out


class Top:
    """Decisions of depths nought to two: the mixed chance of a one, and the weight left for what lies deeper."""

    def __init__(self, keys, ones, visits, below):
        order = np.argsort(keys)
        keys, ones, visits, below = keys[order], ones[order], visits[order], below[order]
        levels = []
        for depth in (2, 1, 0):
            levels.append(Level(keys, ones, visits, below))
            if depth:
                up = strip(keys, depth - 1)
                order = np.argsort(up, kind="stable")
                keys, ones, visits, below = run_sums(up[order], ones[order], visits[order], levels[-1].total[order])
        two, one, nought = levels
        self.keys, self.chance, self.rest = [nought.keys], [nought.share * nought.chance], [1 - nought.share]
        for depth, level in ((1, one), (2, two)):
            at = np.searchsorted(self.keys[-1], strip(level.keys, depth - 1))
            self.keys.append(level.keys)
            self.chance.append(self.chance[-1][at] + self.rest[-1][at] * level.share * level.chance)
            self.rest.append(self.rest[-1][at] * (1 - level.share))

    def start(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance, rest) as mixed down to depth two; where a depth was never met the rest is a half."""
        chance, rest, open_ = np.full(len(keys), 0.5), np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
        for depth in range(3):
            if not len(self.keys[depth]):
                break
            cut = strip(keys, depth)
            at = np.minimum(np.searchsorted(self.keys[depth], cut), len(self.keys[depth]) - 1)
            hit = open_ & (self.keys[depth][at] == cut)
            deeper = self.rest[depth][at] if depth == 2 else 0.0
            half = 0.0 if depth == 2 else self.rest[depth][at] / 2
            chance, rest, open_ = np.where(hit, self.chance[depth][at] + half, chance), np.where(hit, deeper, rest), hit
        return chance, rest


def string_logs(queries: np.ndarray, levels: dict, top: Top) -> np.ndarray:
    """log10 of the predicted byte's probability in each string, met in training or not."""
    out, byte, ctx = np.zeros(len(queries)), queries & 255, queries >> 8 << 8
    for k in range(8):
        keys = ctx | NODES[byte, k]
        chance, rest = top.start(keys)
        for depth in range(3, DEPTH + 1):
            level = levels[depth, k]
            at, hit = level.find(strip(keys, depth))
            if not len(level.keys):
                chance, rest = chance + rest / 2, rest * 0
                continue
            chance = chance + rest * np.where(hit, level.share[at] * level.chance[at], 0.5)
            rest = np.where(hit, rest * (1 - level.share[at]), 0.0)
        out += np.log10(np.where(BITS[byte, k] == 1, chance, 1 - chance))
    return out


class Table:
    """Exact hash table from codes to values in eight bytes a slot.

    An odd multiplier permutes the codes; the upper bits are the home slot,
    the lower ones with the distance from home the tag, so a tag stands for
    one code only.
    """

    ODD = 0x9E3779B97F4B

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.k = max(WIDTH - 26, int(2 * max(1, len(codes)) - 1).bit_length())
        self.tags = np.full((1 << self.k) + 64, 0xFFFFFFFF, dtype=np.uint32)
        self.values = np.zeros(len(self.tags), dtype=np.float32)
        home, low = self.spread(codes)
        todo = np.arange(len(codes))
        for step in range(63):
            slot = home[todo] + step
            free = self.tags[slot] == 0xFFFFFFFF
            first = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.tags[slot[won]] = low[todo[won]] << 6 | step
            self.values[slot[won]] = values[todo[won]]
            keep = np.ones(len(todo), dtype=bool)
            keep[won] = False
            todo = todo[keep]
            if not len(todo):
                return
        raise ValueError("a run of full slots is longer than 63")

    def spread(self, codes):
        mixed = (codes.astype(np.uint64) * np.uint64(self.ODD)) & np.uint64((1 << WIDTH) - 1)
        return (mixed >> np.uint64(WIDTH - self.k)).astype(np.int64), (mixed & np.uint64((1 << (WIDTH - self.k)) - 1)).astype(np.uint32)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        home, low = self.spread(codes)
        low <<= np.uint32(6)
        out, found = np.zeros(len(codes), dtype=np.float32), np.zeros(len(codes), dtype=bool)
        todo = None
        for step in range(63):
            slot, tag = (home, low) if todo is None else (home[todo] + step, low[todo] | np.uint32(step))
            there = self.tags[slot]
            hit = there == tag
            if todo is None:
                out[hit], found[hit] = self.values[slot[hit]], True
                todo = np.flatnonzero(~hit & (there != 0xFFFFFFFF))
            else:
                out[todo[hit]], found[todo[hit]] = self.values[slot[hit]], True
                todo = todo[~hit & (there != 0xFFFFFFFF)]
            if not len(todo):
                break
        return out, found


def train(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> dict:
    """Word counts, totals and the context tables of the training texts."""
    counted = scratch.keep("counted", docs.select(F.col("text").cast("string")).mapInArrow(count_batches, "word binary, code long, n long"))
    vocab = scratch.keep("vocab", counted.where("code is null").groupBy("word").agg(F.sum("n").alias("n")))
    n, v = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = vocab.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the least power of two that at most HEAD words reach, from a histogram of 64 rows
    hist = {r[0]: r[1] for r in vocab.where("word is not null").groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    least, seen = 0, 0
    for k in sorted(hist, reverse=True):
        seen += hist[k]
        least = k if seen <= HEAD else least
        if seen > HEAD:
            least = k + 1
            break
    often = vocab.where(F.col("word").isNotNull() & (F.col("n") >= (1 << least))).toArrow()
    head = dict(zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True)) if hist else {}
    del often
    gram = scratch.keep("grams", counted.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")))
    parts = max(1, -(-gram.count() // PART))
    near = F.col("code").bitwiseAND(F.lit(0xFFFFFF00))
    dealt = gram.withColumn("near", near).repartition(parts, "near").select("code", "n")

    def shallow(batches):
        code, n = gathered(batches)
        found = [x for (depth, _), x in deep_levels(code, n).items() if depth == 3]
        keys = np.concatenate([strip(x.keys, 2) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys, *(np.concatenate([x.counts[i] for x in found]) for i in (0, 1)), np.concatenate([x.total for x in found]))], names=["key", "ones", "visits", "below"])

    top = dealt.mapInArrow(shallow, "key long, ones double, visits double, below double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("ones", "visits", "below"))).toArrow()
    tree = Top(*(top.column(c).to_numpy() for c in ("key", "ones", "visits", "below")))
    return {"n": n, "v": v, "end": end, "head": head, "vocab": vocab, "top": spark.sparkContext.broadcast(tree), "grams": gram, "parts": parts}


def gathered(batches) -> tuple[np.ndarray, np.ndarray]:
    """A partition's two columns whole; partitions are made bounded."""
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    return tuple(np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=np.int64) for i in (0, 1))


def logs_of(strings: DataFrame, model: dict, queries: bool = False) -> DataFrame:
    """(code, log) of the training strings, which have n, or else of queries beside them, whose n is null."""
    top = model["top"]
    near = F.col("code").bitwiseAND(F.lit(0xFFFFFF00))
    dealt = strings.withColumn("near", near).repartition(model["parts"], "near").select("code", F.coalesce("n", F.lit(0)).alias("n"))

    def run(batches):
        code, n = gathered(batches)
        levels = deep_levels(code[n > 0], n[n > 0])
        asked = code[n == 0] if queries else code
        for at in range(0, len(asked), 200_000):
            some = asked[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(string_logs(some, levels, top.value))], names=["code", "log"])

    return dealt.mapInArrow(run, "code long, log double")


def score(spark: SparkSession, docs: DataFrame, mod: int = 7, held: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row, learning from the training fold."""
    scratch = Scratch(spark, "lm")
    # keys may repeat, and the texts are read more than once
    rows = with_rid(docs, key, scratch).select(F.col("__rid").alias("rid"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = train(spark, rows.where(fold("doc_id", mod) != held), scratch)
    n, v, end = model["n"], model["v"], model["end"]
    logs = scratch.keep("logs", logs_of(model["grams"], model))
    blocks = max(1, -(-logs.count() // BLOCK))
    head = spark.sparkContext.broadcast({w: math.log10(c + 1) for w, c in model["head"].items()})
    out = None
    for b in range(blocks):
        got = logs.where(F.pmod("code", F.lit(blocks)) == b).select("code", F.col("log").cast("float").alias("log")).toArrow()
        sent = spark.sparkContext.broadcast(Table(got.column("code").to_numpy(), got.column("log").to_numpy()))
        del got
        one = rows.mapInArrow(scorer(sent, head, b, blocks), SCORED)
        out = one if out is None else out.union(one)
    scored = scratch.keep("scored", out)
    # words outside the head, by an equi-join on the word
    rare = scored.where("word is not null").select("rid", "doc_id", "word", F.col("n_tokens").alias("times"))
    rare = rare.join(model["vocab"].where("word is not null"), "word").select("rid", "doc_id", F.col("times").alias("n_known"), (F.col("times") * F.log10(F.col("n") + 1)).alias("part"))
    # byte strings never met in training: each once through the tree, then an equi-join
    odd = scored.where("code is not null").select("rid", "doc_id", "code", F.col("n_tokens").alias("times"))
    asked = odd.select("code").distinct().withColumn("n", F.lit(None).cast("long"))
    odd_logs = logs_of(model["grams"].unionByName(asked), model, queries=True)
    odd = odd.join(odd_logs, "code").select("rid", "doc_id", (F.col("times") * F.col("log")).alias("score"))
    base = scored.where("word is null and code is null").select("rid", "doc_id", "n_tokens", "n_known", "part", "score", "n_bytes")
    both = base.unionByName(rare.select("rid", "doc_id", F.lit(0).cast("long").alias("n_tokens"), "n_known", "part", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_bytes")))
    both = both.unionByName(odd.select("rid", "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "n_bytes")), F.lit(0.0).alias("part"), "score"))
    total = both.groupBy("rid", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "part", "score", "n_bytes")))
    known = F.lit(1 if end else 0)
    return total.select(
        "doc_id", (fold("doc_id", mod) == held).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("part") + F.lit(math.log10(end + 1)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), "score", "n_bytes",
        (F.col("score") * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


SCORED = "rid long, doc_id long, word binary, code long, n_tokens long, n_known long, part double, score double, n_bytes long"


def scorer(sent, head, block: int, blocks: int):
    """Rows of each text, and one for each of its words or byte strings that the tables lack."""

    def run(batches):
        known, kinds = head.value, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        for batch in batches:
            rids, docs, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for texts in portions(batch.column(2)):
                some = [tokens(x) for x in texts]
                sizes = np.array([sum(map(len, w)) + max(0, len(w) - 1) + 1 for w in some])
                codes = grams(some)
                whose = np.repeat(np.arange(len(some)), sizes)
                sums, odd = np.zeros(len(some)), []
                for lo in range(0, len(codes), 500_000):
                    c, d = codes[lo : lo + 500_000], whose[lo : lo + 500_000]
                    if blocks > 1:
                        mine = c % blocks == block
                        c, d = c[mine], d[mine]
                    value, found = sent.value.get(c)
                    sums += np.bincount(d, value, minlength=len(some))
                    odd.append((d[~found], c[~found]))
                out: list[list] = [[] for _ in kinds]
                who, what = (np.concatenate([o[i] for o in odd]) for i in (0, 1))
                if len(who):
                    order = np.lexsort((what, who))
                    who, what = who[order], what[order]
                    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])))
                    times = np.diff(np.append(first, len(who)))
                    for i, c, t in zip(who[first].tolist(), what[first].tolist(), times.tolist(), strict=True):
                        add(out, rids[at + i], docs[at + i], None, c, t, 0, 0.0, 0.0, 0)
                for rid, doc, w, s, n in zip(rids[at : at + len(some)], docs[at : at + len(some)], some, sums.tolist(), sizes.tolist(), strict=True):
                    if block:
                        add(out, rid, doc, None, None, 0, 0, 0.0, s, 0)
                        continue
                    got = list(map(known.get, w))
                    rare = Counter(x for x, g in zip(w, got, strict=True) if g is None)
                    for x, t in rare.items():
                        add(out, rid, doc, x, None, t, 0, 0.0, 0.0, 0)
                    add(out, rid, doc, None, None, len(w) + 1, len(w) - rare.total(), math.fsum(g for g in got if g is not None), s, n)
                at += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["rid", "doc_id", "word", "code", "n_tokens", "n_known", "part", "score", "n_bytes"])

    return run


def add(columns: list[list], *row) -> None:
    for column, value in zip(columns, row, strict=True):
        column.append(value)
