"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: 64 majority bits over XXH64 (seed 42) of the 4-word shingles of
the lower-cased (A-Z) text. Distinct fingerprints are cut into tiles along
their population counts; a pair of tiles is compared, exclusive-or and bit
count in numpy, only if some pair in it could lie within the radius. A tile
pair returns a spanning forest of its links, never the links themselves, so a
large group of near copies costs no more output than it has members.

Defined results: a null or empty text has fingerprint zero and links like any
other; equal texts share a fingerprint; other columns do not matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch, components

TILE = 1024
RADIUS = 4
#: Population counts of the low and the high half: 33 x 33 cells.
CELLS = 33 * 33


def fingerprint_bytes(text: str | None, words: int = 4) -> int:
    """Fingerprint of one whole text."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4) -> DataFrame:
    """(doc_id, fp): one narrow pass over whole texts; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint_bytes(x, words) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def tile_plan(counts: dict[tuple[int, int], int], tile: int = TILE) -> tuple[dict[tuple[int, int], tuple[int, int]], list[tuple[int, int, int, int]]]:
    """From the histogram over (low, high) population counts: cell -> (first tile, tiles), and each tile's box.

    Cells stand in order of total and low count; a large cell is cut into
    several tiles, neighbouring small cells of one total share one.
    """
    place: dict[tuple[int, int], tuple[int, int]] = {}
    boxes: list[list[int]] = []
    room, last = 0, None
    for lo, hi in sorted(counts, key=lambda c: (c[0] + c[1], c[0])):
        n = counts[lo, hi]
        if n > tile:
            parts = -(-n // tile)
            place[lo, hi] = (len(boxes), parts)
            boxes += [[lo, lo, hi, hi] for _ in range(parts)]
            room = 0
            continue
        if room < n or last != lo + hi:
            boxes.append([lo, lo, hi, hi])
            room = tile
        b = boxes[-1]
        boxes[-1] = [min(b[0], lo), max(b[1], lo), min(b[2], hi), max(b[3], hi)]
        place[lo, hi] = (len(boxes) - 1, 1)
        room, last = room - n, lo + hi
    return place, [tuple(b) for b in boxes]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least distance that population counts allow between boxes (low min, low max, high min, high max)."""
    low = np.maximum(0, np.maximum(b[..., 0] - a[..., 1], a[..., 0] - b[..., 1]))
    high = np.maximum(0, np.maximum(b[..., 2] - a[..., 3], a[..., 2] - b[..., 3]))
    return low + high


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest, as positions in left + right, of pairs within the radius; right None: pairs inside left.

    Groups are kept as labels, so memory stays that of the tiles however many pairs link.
    """
    other, shift, n = (left, 0, len(left)) if right is None else (right, len(left), len(left) + len(right))
    label = np.arange(n)
    for i in range(0, len(left), 128):
        near = np.bitwise_count(left[i : i + 128, None] ^ other[None, :]) <= radius
        for a in np.flatnonzero(near.any(axis=1)).tolist():
            met = label[shift + np.flatnonzero(near[a])]
            if (met != label[i + a]).any():
                ids = np.unique(np.append(met, label[i + a]))
                label[np.isin(label, ids)] = ids[0]
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(moved.tolist(), label[moved].tolist(), strict=True))


def link_edges(spark: SparkSession, fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) edges spanning every group of distinct fingerprints linked within ``radius``.

    ``fps`` has distinct longs in ``fp``. What reaches the driver is a
    histogram of at most 1,089 cells; tiles and their pairs are dealt out on
    the executors.
    """
    low, high = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("fp", 32))
    celled = fps.select("fp", low.alias("lo"), high.alias("hi"))
    counts = {(r[0], r[1]): r[2] for r in celled.groupBy("lo", "hi").count().collect()}
    place, boxes = tile_plan(counts, tile)
    if not boxes:
        return spark.createDataFrame([], "u long, v long")
    plan = spark.sparkContext.broadcast((place, np.array(boxes, dtype=np.int32)))

    def tiles(batches):
        place, _ = plan.value
        for batch in batches:
            fp, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = [place[a, b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            mixed = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            t = [first + int(m) % n for (first, n), m in zip(at, mixed, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), batch.column(0)], names=["tile", "fp"])

    def partners(batches):
        _, boxes = plan.value
        for batch in batches:
            for t, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                other = np.nonzero(apart(boxes[t], boxes) <= radius)[0]
                first, second = np.minimum(other, t), np.maximum(other, t)
                raw = np.array(fp, dtype="<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array([t] * len(other), pa.int32()), pa.array([raw] * len(other), pa.binary())], names=["a", "b", "tile", "fps"])

    def compare(batches):
        for batch in batches:
            u, v = [], []
            for a, b, left, right in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(left, dtype="<i8")
                y = x if a == b else np.frombuffer(right, dtype="<i8")
                both = x if a == b else np.concatenate((x, y))
                for i, j in tile_links(x.view(np.uint64), None if a == b else y.view(np.uint64), radius):
                    u.append(int(both[i]))
                    v.append(int(both[j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    # at most about TILE fingerprints a tile, so collect_list is bounded
    tiled = celled.mapInArrow(tiles, "tile int, fp long").groupBy("tile").agg(F.collect_list("fp").alias("fps"))
    pairs = tiled.mapInArrow(partners, "a int, b int, tile int, fps binary").repartition("a", "b")
    units = pairs.groupBy("a", "b").agg(F.min_by("fps", "tile").alias("l"), F.max_by("fps", "tile").alias("r"))
    return units.mapInArrow(compare, "u long, v long")


def classes(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable by links."""
    scratch = Scratch(spark, "simhash")
    fps = scratch.keep("fps", fingerprints(docs, text, key, words))
    distinct = scratch.keep("distinct", fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(spark, link_edges(spark, distinct.select("fp"), radius), "simhash-cc")
    linked = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
