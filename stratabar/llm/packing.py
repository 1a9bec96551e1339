"""Packing documents into fixed windows by non-negative least squares.

Every document becomes ids plus one end id. Whole windows of it are sequences
of their own; what remains is shorter than a window, so a histogram of at most
1,023 lengths describes all remainders. Pairs and triples of lengths that fill
a window exactly are enumerated, their repeat counts solved against the
histogram by non-negative least squares, rounded down, topped up greedily, and
the residue is laid end to end and cut at window borders; its last, partial
window is split into powers of two, which need no padding.

Placement is closed-form: the n-th remainder of a length has a known sequence
and offset, and ranks come from counts per (task, length). Nothing per document
reaches the driver, and a hot length is never gathered in one task.

Defined results: a null or empty text is the end id alone; a text of any length
is packed whole; repeated rows are packed each; other columns do not matter;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratabar.llm.common import Scratch

WINDOW = 1024
END = 0
_CODERS: dict = {}


class Pieces(dict):
    """Ids by word as it stands: a line feed before it means a new line, a zero the text's start, else a space precedes it.

    The last generation of words is kept beside the present one, which bounds
    memory and keeps frequent words.
    """

    LIMIT = 200_000

    def __init__(self, encode, feed: bytes):
        super().__init__()
        self.encode, self.feed, self.old = encode, feed, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            first = word[0]
            got = self.feed + self.encode(word[1:]) if first == "\n" else self.encode(word[1:] if first == "\0" else " " + word)
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Coder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    In this vocabulary's split pattern a single space before a visible
    character always begins a piece, and a single line feed between visible
    characters is a piece, so words can be encoded apart and remembered.
    Texts with any other white space, or special marks, are encoded whole.
    ``path`` is a tokenizers file; ``ranks``, where given, the same vocabulary
    as a rank file, used for single words.
    """

    OTHER = re.compile("[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")

    #: Words left to the faster library: letters of Latin scripts, digits and ASCII marks.
    PLAIN = re.compile("[\x20-\x7e\u00c0-\u024f]+")

    def __init__(self, path: str | None, ranks: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
            ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.tokenizer = Tokenizer.from_file(path)
        self.words = self.by_rank(ranks) if ranks else None
        self.known = Pieces(self.word, self.raw("\n"))

    @staticmethod
    def by_rank(path: str):
        """The same vocabulary in tiktoken, several times as fast on one word."""
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def word(self, word: str) -> bytes:
        if self.words is None or not self.PLAIN.fullmatch(word):
            return self.raw(word)
        return array("I", self.words.encode_ordinary(word)).tobytes()

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if "<|" in text or self.OTHER.search(text) or len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return self.raw(text)
        return b"".join(map(self.known.__getitem__, ("\0" + text.replace("\n", " \n")).split(" ")))


def coder(path: str | None) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def combinations(window: int, hist: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, c or b summing to the window; a is 0 in pairs. Only lengths that occur."""
    a, b = np.meshgrid(np.arange(0, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    c = window - a - b
    keep = (a <= b) & (b <= c) & (c < window)
    rows = np.stack([a[keep], b[keep], c[keep]], axis=1)
    there = np.append(True, hist[1:] > 0)
    return rows[there[rows].all(axis=1)]


def solve(rows: np.ndarray, hist: np.ndarray, steps: int = 200) -> np.ndarray:
    """min |A x - hist| over x >= 0 by accelerated projected gradient; A's columns count the lengths of a row."""
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    use = hist.astype(float).copy()
    use[0] = 0
    ahead = lambda x: np.bincount(rows.ravel(), np.repeat(x, 3), minlength=len(hist)) * (np.arange(len(hist)) > 0)
    back = lambda r: r[rows].sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(20):
        v = back(ahead(v))
        norm = np.linalg.norm(v)
        v /= norm
    y, t = x, 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - back(ahead(y) - use) / (1.02 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def repeat_counts(rows: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts that never use more of a length than there is, and what is left of each length."""
    x = solve(rows, hist)
    left = hist.astype(np.int64).copy()
    counts = np.zeros(len(rows), dtype=np.int64)
    for top_up in (False, True):
        for i in np.argsort(-x, kind="stable"):
            want = int(x[i]) if not top_up else 1 << 62
            if want == 0:
                break
            used: dict[int, int] = {}
            for k in rows[i].tolist():
                if k:
                    used[k] = used.get(k, 0) + 1
            n = min(want, *(int(left[k]) // m for k, m in used.items()))
            if n > 0:
                counts[i] += n
                for k, m in used.items():
                    left[k] -= n * m
    return counts, left


def layout(hist: np.ndarray, window: int = WINDOW) -> dict:
    """Tables that place the n-th remainder of each length; bounded by the window alone."""
    rows = combinations(window, hist)
    counts, left = repeat_counts(rows, hist)
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]  # (repeats, first sequence, offset)
    seq = 0
    for i in np.nonzero(counts)[0]:
        at = 0
        for k in rows[i].tolist():
            if k:
                slots[k].append((int(counts[i]), seq, at))
                at += k
        seq += int(counts[i])
    table = []
    stream = 0
    for k in range(window):
        runs = np.array(slots[k], dtype=np.int64).reshape(-1, 3)
        table.append((np.cumsum(runs[:, 0]), runs[:, 1], runs[:, 2], stream))
        stream += int(left[k]) * k if k else 0
    full, tail = divmod(stream, window)
    borders, at = [], full * window
    for bit in reversed(range(window.bit_length())):
        if tail >> bit & 1:
            borders.append(at)
            at += 1 << bit
    return {"table": table, "stream_seq": seq, "full": full, "borders": np.array(borders, dtype=np.int64), "next": seq + full + len(borders), "stream": stream}


def place(plan: dict, length: int, rank: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a remainder."""
    ends, first, offsets, stream = plan["table"][length]
    done = int(ends[-1]) if len(ends) else 0
    if rank < done:
        i = int(np.searchsorted(ends, rank, side="right"))
        before = int(ends[i - 1]) if i else 0
        return [(0, length, int(first[i]) + rank - before, int(offsets[i]))]
    pos = stream + (rank - done) * length
    out, start, edge = [], 0, plan["full"] * window
    while start < length:
        at = pos + start
        if at < edge:
            k, offset = divmod(at, window)
            n = min(length - start, window - offset)
            out.append((start, n, plan["stream_seq"] + k, offset))
        else:
            b = plan["borders"]
            i = int(np.searchsorted(b, at, side="right")) - 1
            end = int(b[i + 1]) if i + 1 < len(b) else plan["stream"]
            n = min(length - start, end - at)
            out.append((start, n, plan["stream_seq"] + plan["full"] + i, at - int(b[i])))
        start += n
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file present on every worker.
    Sequence ids are unique, not dense: whole windows carry their task in the
    upper bits.
    """
    scratch = Scratch(spark, "packing")

    def encode(batches):
        code, part = coder(tokenizer), TaskContext.get().partitionId()
        ranks, wins = [0] * window, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = code.ids(x or "") + end.to_bytes(4, "little")
                full, rem = divmod(len(raw) // 4, window)
                cut = full * window * 4
                for col, v in zip(out, (doc, part, rem, ranks[rem], wins, [zlib.crc32(raw[i : i + 4 * window]) for i in range(0, cut, 4 * window)], raw[cut:]), strict=True):
                    col.append(v)
                ranks[rem] += 1
                wins += full
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "part", "rem", "rank", "win", "crcs", "ids"])

    coded = scratch.keep("coded", docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, "doc_id long, part int, rem int, rank long, win long, crcs array<long>, ids binary"))
    counts = coded.groupBy("rem", "part").agg(F.count("*").alias("n"))
    counts = scratch.keep("counts", counts.withColumn("before", F.sum("n").over(Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")))
    hist = np.zeros(window, dtype=np.int64)
    for r in counts.groupBy("rem").agg(F.sum("n")).collect():  # at most one row a length
        hist[r[0]] = r[1]
    hist[0] = 0
    sent = spark.sparkContext.broadcast(layout(hist, window))

    def pieces(batches):
        plan = sent.value
        for batch in batches:
            rows = []
            for doc, part, rem, rank, before, win, crcs, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = len(crcs) * window + rem
                base = (part + 1) << 40
                rows += [(doc, i * window, window, c, total, base + win + i, 0) for i, c in enumerate(crcs)]
                if rem:
                    start = len(crcs) * window
                    rows += [(doc, start + s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), total, seq, at) for s, n, seq, at in place(plan, rem, rank + before, window)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = coded.join(counts.select("rem", "part", "before"), ["rem", "part"]).select("doc_id", "part", "rem", "rank", "before", "win", "crcs", "ids")
    return placed.mapInArrow(pieces, PIECES)
