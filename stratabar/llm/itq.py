"""Embedding near-duplicates by iterative quantisation.

A rotation for balanced binary codes (Gong and Lazebnik 2011) is learned in
numpy from a bounded sample (``SAMPLE`` vectors chosen by a hash of the id):
unit vectors are centred and turned to principal axes, and the rotation
alternates with the signs it yields. Every vector gets a code of up to 64 bits,
cut into ``TABLES`` substrings, each the key of one Hamming table within its
label. Vectors that share a key and whose whole codes differ in at most
``RADIUS`` of their bits are compared with their original vectors in double
precision. A pair is counted only in the first table where it meets.

Equal vectors are one class and compared once. A bucket of any size is cut into
chunks; each pair of chunks is a unit of work that returns link counts and a
spanning forest, never the pairs, so every link counts yet a large group of
near copies costs output in proportion to its members.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label, link with nothing and keep their own
id as component. Vectors of another length than the most frequent one are
compared exactly within their label and length. Ids should be unique; an empty
table gives an empty result; other columns do not matter. Recall against brute
force is measured in the tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch, components

SAMPLE = 20_000
TABLES = 7
CHUNK = 1_024
#: Share of a code in which vectors that are compared may differ; a cosine of 0.98 turns about 0.064 of random cuts.
RADIUS = 0.3
COSINE = 0.98


def unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are the code."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
        turn = left @ right
    return mean, axes @ turn


def codes_of(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (vectors - mean) @ projection >= 0
    padded = np.zeros((len(vectors), 64), dtype=bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<i8").ravel()


def spans(bits: int, tables: int) -> list[tuple[int, int]]:
    """(shift, mask) of the substrings."""
    edges = [bits * t // tables for t in range(tables + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def vectors_of(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["u"]), dtype=np.float64).reshape(len(frame), -1)


def unit_links(left: pd.DataFrame, right: pd.DataFrame | None, table: int, cut: list[tuple[int, int]], cosine: float, radius: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(links of left's rows, of right's rows, forest by position in left + right) of one pair of chunks."""
    a = vectors_of(left)
    b = a if right is None else vectors_of(right)
    other = left if right is None else right
    ca, cb = left["code"].to_numpy(), other["code"].to_numpy()
    i, j = np.nonzero(np.bitwise_count(ca.view(np.uint64)[:, None] ^ cb.view(np.uint64)[None, :]) <= radius)
    for shift, mask in cut[:table]:  # met in an earlier table
        new = (ca[i] >> shift & mask) != (cb[j] >> shift & mask)
        i, j = i[new], j[new]
    # few candidates: their products alone
    like = np.einsum("ij,ij->i", a[i], b[j]) if len(i) < 0.02 * len(a) * len(b) else (a @ b.T)[i, j]
    near = np.zeros((len(a), len(b)), dtype=bool)
    near[i, j] = like >= cosine
    if right is None:
        np.fill_diagonal(near, False)
    shift, n = (0, len(left)) if right is None else (len(left), len(left) + len(right))
    label = np.arange(n)
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        met = label[shift + np.flatnonzero(near[i])]
        if (met != label[i]).any():
            ids = np.unique(np.append(met, label[i]))
            label[np.isin(label, ids)] = ids[0]
    moved = np.flatnonzero(label != np.arange(n))
    return near @ other["copies"].to_numpy(), (near.T @ left["copies"].to_numpy()) if right is not None else np.zeros(0, dtype=np.int64), list(zip(moved.tolist(), label[moved].tolist(), strict=True))


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", tables: int = TABLES, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    scratch = Scratch(spark, "itq")
    all_rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    classes = scratch.keep("classes", all_rows.where(fit).groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")))
    sizes = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = sizes["d"]
    bits = min(dim, 64)
    draw = F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / sizes["count"]))
    fitted = classes.where((F.size("v") == dim) & draw).select("cls", F.col("v").cast("array<double>").alias("v")).toPandas().sort_values("cls")
    if not len(fitted):
        fitted = classes.where(F.size("v") == dim).select("cls", F.col("v").cast("array<double>").alias("v")).limit(1).toPandas()
    model = spark.sparkContext.broadcast(learn(unit_rows(fitted["v"]), bits))

    def encode(batches):
        mean, projection = model.value
        for batch in batches:
            vs = batch.column(1).to_pylist()
            code = np.zeros(len(vs), dtype=np.int64)
            units: list = [None] * len(vs)
            for size in {len(v) for v in vs}:
                at = [i for i, v in enumerate(vs) if len(v) == size]
                unit = unit_rows([vs[i] for i in at])
                if size == dim:
                    code[at] = codes_of(unit, mean, projection)
                for i, u in zip(at, unit, strict=True):
                    units[i] = u.tobytes()
            cols = [batch.column(0), pa.array([len(v) for v in vs], pa.int32()), pa.array(units, pa.binary()), batch.column(2), batch.column(3), pa.array(code)]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "d", "u", "cls", "copies", "code"])

    kind = dict(classes.dtypes)
    coded = scratch.keep("coded", classes.select("label", F.col("v").cast("array<double>").alias("v"), "cls", "copies").mapInArrow(encode, f"label {kind['label']}, d int, u binary, cls long, copies long, code long"))
    cut = spans(bits, tables)
    keys = F.array(*(F.shiftrightunsigned("code", s).bitwiseAND(F.lit(m)) for s, m in cut))
    radius = round(RADIUS * bits)
    keyed = coded.select("label", "d", "cls", "copies", "code", "u", F.posexplode(keys).alias("t", "k")).where((F.col("d") == dim) | (F.col("t") == 0))
    buckets = keyed.groupBy("label", "d", "t", "k").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / chunk).cast("int")).drop("count")
    there = keyed.join(buckets, ["label", "d", "t", "k"]).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    units = there.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, t = frame["i"].iloc[0], frame["j"].iloc[0], int(frame["t"].iloc[0])
        left = frame[frame["c"] == i]
        right = None if i == j else frame[frame["c"] == j]
        if not len(left) or right is not None and not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": [], "edge": []}).astype({"a": "int64", "b": "int64", "n": "int64", "edge": "bool"})
        la, lb, tree = unit_links(left, right, t, cut, cosine, radius)
        ids = left["cls"].to_numpy() if right is None else np.concatenate((left["cls"].to_numpy(), right["cls"].to_numpy()))
        links = np.concatenate((la, lb)).astype(np.int64)
        some = links > 0
        a = np.concatenate((ids[some], ids[[x for x, _ in tree]] if tree else ids[:0]))
        b = np.concatenate((np.full(some.sum(), -1), ids[[y for _, y in tree]] if tree else ids[:0]))
        n = np.concatenate((links[some], np.zeros(len(tree), dtype=np.int64)))
        return pd.DataFrame({"a": a, "b": b, "n": n, "edge": np.arange(len(a)) >= some.sum()})

    found = scratch.keep("found", units.groupBy("label", "d", "t", "k", "i", "j").applyInPandas(compare, "a long, b long, n long, edge boolean"))
    links = found.where("not edge").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comp = components(spark, found.where("edge").select(F.col("a").alias("u"), F.col("b").alias("v")), "itq-cc").withColumnRenamed("node", "cls")
    done = classes.select("label", "v", "cls", "copies").join(links, "cls", "left").join(comp, "cls", "left")
    done = done.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = all_rows.join(done, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
