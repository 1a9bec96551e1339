"""Each operator against a brute-force version, and on awkward tables."""

import base64
import collections
import hashlib
import math
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratabar.llm import balltree, common, itq, linededup, lm_score, mixing, packing, pii, queries, secret_scan, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, key string, fp long, line int"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "One two three four five six\nmail a.b@c.de and +1 (222) 555-1234"), (5, "One two three four five six\nmail a.b@c.de and +1 (222) 555-1234"), (6, long), (7, "a" * 200_000), (8, "1 " * 50_000), (9, ".".join(["a@b"] + ["c"] * 30_000)), (None, "no id"), (10, "été \U0001f600 x@y.zz"), (4, "One two three four five six\nmail a.b@c.de and +1 (222) 555-1234")]
    return spark.createDataFrame([(i, t, None, None if i == 4 else "s", None, 0.5, "w", "k", 1, 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(300):
        v = base[i % 60] + rng.normal(size=16) * (0.0 if i % 7 == 0 else 0.05)
        rows.append((i, v.astype("float32").tolist(), i % 3, "x", 1))
    rows += [(900, None, 1, "x", 1), (901, [float("nan")] * 16, 1, "x", 1), (902, [0.0] * 16, 1, "x", 1), (903, rows[0][1], None, "x", 1), (904, [1.0, 2.0], 1, "x", 1), (905, [2.0, 4.0], 1, "x", 1), (906, [None] * 16, 2, "x", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, n long")


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 80)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1100, size=(40, 2))]
    pairs = chain + star + loose
    got = {r[0]: r[1] for r in common.components(spark, spark.createDataFrame(pairs, "u long, v long"), "t").collect()}
    want = union(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == set(want)
    assert common.components(spark, spark.createDataFrame([], "u long, v long"), "t").count() == 0


# -- toxicity -----------------------------------------------------------------
def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(0)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1600):
        w = rng.choice(vocab, 40).tolist()
        bad = i % 8 == 0
        rows.append((i, " ".join(w + (["idiot", "Scum!"] if bad else []))))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.digest(toxicity.score(spark, d, toxicity.train(spark, d, lab))).collect()
    assert len(out) == 1600
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 8 == 0) for r in held]) > 0.97


def test_toxicity_risk_never_rewards_negative():
    rows = [np.array([0]), np.array([0]), np.array([1]), np.array([1]), np.array([], dtype=int)]
    w, b = toxicity.fit_weights(rows, np.array([True, True, False, False, False]), 2, 0.3)
    assert w[0] > w[1] and np.isfinite(w).all() and np.isfinite(b)


def plain_risk(theta, rows, positive, prior, decay):
    """(risk, bracket) of Kiryo et al. text by text, with weight decay."""
    sigma = lambda r: 1 / (1 + math.exp(-(theta[-1] + sum(theta[int(c)] for c in r))))
    pos, unl = [sigma(r) for r, p in zip(rows, positive, strict=True) if p], [sigma(r) for r, p in zip(rows, positive, strict=True) if not p]
    bracket = sum(unl) / len(unl) - prior * sum(pos) / len(pos)
    ridge = decay / 2 * sum(t * t for t in theta[:-1])
    return prior * sum(1 - s for s in pos) / len(pos) + bracket + ridge, bracket, ridge - bracket


def test_toxicity_gradient_against_finite_differences():
    rng = np.random.default_rng(9)
    signs = set()
    for k in range(30):
        rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(25)]
        positive, prior = np.arange(25) < 8, [0.1, 0.8][k % 2]
        theta = rng.normal(size=7) * 2 + np.append(np.zeros(6), [0.0, -2.0][k % 2])
        cols, at = np.concatenate(rows), np.repeat(np.arange(25), [len(r) for r in rows])
        got = toxicity.descent(theta, cols, at, positive, prior, 0.01)
        below = plain_risk(theta, rows, positive, prior, 0.01)[1] < 0
        signs.add(below)
        value = lambda t: plain_risk(t, rows, positive, prior, 0.01)[2 if below else 0]  # noqa: B023, E731
        want = [(value(theta + e) - value(theta - e)) / 2e-6 for e in np.eye(7) * 1e-6]
        assert np.allclose(got, want, atol=1e-7)
    assert signs == {True, False}


def test_toxicity_scores_are_direct_sums(spark, docs, texts):
    model = {"weights": {"the": 0.7, "and": -1.3, "that": 0.2, "ther~": 0.9, "die": -0.4}, "bias": -0.5}
    for r in toxicity.score(spark, docs, model).collect():
        words = set(re.sub(r"""[.,;:!?"'()\[\]{}<>|*_#]""", " ", (texts[r["doc_id"]] or "").lower()).split())
        features = words | {w[:n] + "~" for n in (4, 5) for w in words if len(w) > n}
        z = model["bias"] + sum(x for f, x in model["weights"].items() if f in features)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-12)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(spark, odd, labels)
    out = toxicity.score(spark, odd, model).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(spark, empty, toxicity.train(spark, empty, labels.limit(0))).count() == 0
    assert toxicity.keep_below(spark, odd, model, 1.1).count() == 12


# -- personal data ------------------------------------------------------------------
def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def plain_pii(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


HARD = [
    "a@b.cd%e@f.gh i@j k@l.m.n.o.", "1.2.3.4.5.6.7.8 001.002.003.004 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 5 -6", "4111111111111111@x.yz", "+1 (222) 555-1234 +12 +1234567890123456 ++4930123456-",
    "\U0001f600 a@b.cd é 10.0.0.1", "x" * 3000 + "@", "1-" * 4000, "....@a.b", "a@b.c@d.e",
]


def test_pii_plain(spark, texts):
    every = dict(enumerate(HARD)) | {1000 + i: t for i, t in texts.items()}
    d = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    for r in pii.digest(pii.find(spark, d)).collect():
        want = plain_pii(every[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (every[r["doc_id"]][:80], want, r["spans"])
        assert r["spans"].startswith(want)


def test_pii_context_is_learned(spark):
    rows = [(i, f"text contact user{i}@mail.example.org ok") for i in range(12)] + [(100, "text contact 55512345678901 ok"), (101, "other words 1234567 here")]
    out = {r["doc_id"]: r for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100]["spans"] == "context:13:27" and out[101]["n_context"] == 0


def test_pii_grouped_and_short_identifiers(spark):
    told = {100: "GB29 NWBK 6016 1331 9268 19", 101: "0221 555 1234", 102: "AB12345", 103: "jsmithson", 104: "42"}
    rows = [(i, f"text contact user{i}@mail.example.org ok") for i in range(40)] + [(k, f"text\ncontact  ({v}), ok" if k == 103 else f"text contact {v} ok") for k, v in told.items()]
    rows += [(200 + i, f"page {10 + i} of the text") for i in range(30)] + [(300, "other words 555 12 here, 0221 and 1234")]
    out = {r["doc_id"]: r for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, v in told.items():
        at = dict(rows)[k].index(v)
        assert out[k]["spans"] == ("" if k == 104 else f"context:{at}:{at + len(v)}"), (k, out[k])
    assert not any(r["n_context"] for i, r in out.items() if i not in told)


def test_pii_takes_long_texts(spark):
    n = 150_000
    start = time.time()
    got = pii.find(spark, spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n))), (2, "a@b.co " * n), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_email"] for r in got] == [0, n, 0] and got[1]["base"].endswith(f"email:{7 * n - 7}:{7 * n - 1}")
    assert time.time() - start < 120


def test_running_sums(spark):
    for n in (0, 1, pii.PIECE, pii.PIECE + 1, 5 * pii.PIECE + 3):
        want = np.cumsum(np.arange(n) % 7).tolist()
        df = spark.createDataFrame([([i % 7 for i in range(n)],)], "x array<bigint>")
        assert df.select(pii.running(F.col("x"))).first()[0] == want


def test_pii_marks_runs_and_seeds(spark):
    text = "id (GB29 NWBK 6016 1331) mail a1@b.co, 12 and x9"
    scanned = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = {(r["s"], r["e"]): (r["instance"], r["run"], r["part"], r["seed"]) for r in pii.candidates(scanned).collect()}
    assert got[4, 23] == ("gb29 nwbk 6016 1331", True, False, False) and got[4, 8][2] and not got[4, 8][1]
    assert got[30, 37] == ("a1@b.co", False, got[30, 37][2], True) and got[46, 48] == ("x9", False, False, False)


def test_pii_plain_words_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pick = lambda *of: str(rng.choice(of))
    some = {i: " ".join(pick("the", "id", "(id", "no", "Of") + "\t" + (pick("Abc,", "xy", "(xy)", "", "q") if rng.random() < 0.4 else pick("w", "u") + str(rng.integers(900)) if rng.random() < 0.5 else "v" + "abcdefghij"[rng.integers(10)] + "klmnopqrst"[rng.integers(10)]) for _ in range(12)) for i in range(80)}
    some |= {100 + i: f"ref Zeta. end {i} ref {i}77 end" for i in range(40)} | {200 + i: f"the {''.join(chr(97 + int(x)) for x in str(i))}k of" for i in range(300)} | {600: None, 601: ""}
    t = {"L ref": 40.0, "R end": 80.0, "L the": 30.0, "R of": 25.0, "L id": 700.0, "L no": 60.0, "L (id": 41.5, "L nowhere": 9.0}
    seen, counts, places = collections.defaultdict(collections.Counter), collections.Counter(), []
    for i, text in some.items():
        ws = [(m.group(), m.start()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or "")]
        for j, (w, at) in enumerate(ws):
            if not (x := w.lstrip(pii.OPENING).rstrip(pii.CLOSING).lower()):
                continue
            counts[x] += 1
            places.append((i, at + len(w) - len(w.lstrip(pii.OPENING)), x))
            for p in [f"L {b.lower()}" for b, _ in ws[max(0, j - 1) : j]] + [f"R {a.lower()}" for a, _ in ws[j + 1 : j + 2]]:
                seen[p][x] += 1
    is_word = lambda x: not re.search("[0-9@]", x)
    k, d = ({p: sum(is_word(x) == kind for x in seen[p]) for p in t} for kind in (True, False))
    good = [p for p in t if k[p] and d[p] and t[p] / (k[p] + max(d[p], t[p])) >= pii.CONFIDENT]
    n = collections.Counter()
    for p in good:
        for x in filter(is_word, seen[p]):
            n[x] = max(n[x], seen[p][x])
    kept = {x for x in n if n[x] / counts[x] >= pii.CONFIDENT}
    assert 2 <= len(good) < len([p for p in t if k[p]]) and kept
    docs = spark.createDataFrame(list(some.items()), "__rid long, text string")
    for sent in (pii.SENT, 0):
        monkeypatch.setattr(pii, "SENT", sent)
        scratch = common.Scratch(spark, "words")
        got = pii.plain_words(docs, spark.createDataFrame(list(t.items()), "pattern string, t double"), scratch)
        assert sorted(map(tuple, got.collect())) == sorted((i, s, s + len(x)) for i, s, x in places if x in kept)
        # a pattern before hundreds of words is out before its words are gathered
        edges = spark.read.parquet(*scratch.paths["word-edges"])
        assert edges.where("pattern = 'L the'").isEmpty() and edges.count() <= sum(len(seen[p]) for p in t if k[p] <= t[p])


def test_pii_odd(spark, odd, empty):
    out = pii.find(spark, odd).collect()
    assert len(out) == 12
    assert all(r["n_email"] == 1 and r["n_phone"] == 1 for r in out if r["doc_id"] in (4, 5))
    assert pii.find(spark, empty).count() == 0


# -- mixing -------------------------------------------------------------------
def test_mixing_hits_targets(spark, docs):
    rows = mixing.counted(docs)
    total = rows.agg(F.sum("n_tokens")).first()[0]
    cells = mixing.probabilities(spark, rows).toPandas()
    weight = cells["n"] * cells["f"] / total
    for dim, power in mixing.POWERS.items():
        have = cells["n"].groupby(cells[dim]).sum() / total
        aim = have**power / (have**power).sum()
        assert np.allclose(weight.groupby(cells[dim]).sum(), aim, rtol=1e-8)
    assert math.isclose((cells["n"] * cells["p"]).sum(), mixing.RATE * total, rel_tol=1e-3)


def test_mixing_rakes_many_cells_as_few(spark):
    rows = [(f"s{i}", f"l{j}", f"t{k}", 0.1 + i * j + k, 0.5, 0.3 + j, 0.2 + k) for i in range(3) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, w double, source_share double, lang_share double, topic_share double")
    one, other = ({tuple(r[:3]): r["w"] for r in mixing.rake(cells, few).select(*mixing.DIMS, "w").collect()} for few in (True, False))
    assert len(one) == 27 and all(math.isclose(one[k], other[k], rel_tol=1e-12) for k in one)


def test_mixing_rakes_correlated_cells_to_the_end(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"l{(i + int(rng.random() < 0.05)) % 3}", f"t{(i // 2 + int(rng.random() < 0.05)) % 3}", int(rng.integers(1, 100 * (1 + i)))) for i in range(6) for _ in range(60)]
    rows += [(f"s{i}", f"l{j}", f"t{k}", 30) for i in range(6) for j in range(3) for k in range(3)]
    cells = mixing.probabilities(spark, spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")).toPandas()
    weight = cells["n"] * cells["f"] / cells["n"].sum()
    for dim, power in mixing.POWERS.items():
        have = cells["n"].groupby(cells[dim]).sum() / cells["n"].sum()
        assert np.allclose(weight.groupby(cells[dim]).sum(), have**power / (have**power).sum(), rtol=1e-6)
    assert math.isclose((cells["n"] * cells["p"]).sum(), mixing.RATE * cells["n"].sum(), rel_tol=1e-9)


def test_mixing_odd(spark, odd, empty):
    out = mixing.sample(spark, odd, keep=["score"]).collect()
    assert "score" in out[0].asDict()
    assert len(out) == 12 and all(0 <= r["probability"] <= 1 for r in out)
    assert mixing.sample(spark, empty).count() == 0


# -- embeddings -----------------------------------------------------------------
def test_itq_against_brute_force(spark, vectors):
    got = {r["vec_id"]: r for r in itq.near_duplicates(spark, vectors).collect()}
    rows = [r for r in vectors.collect() if r["label"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    pairs = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"], dtype=float), np.array(b["embedding"], dtype=float)
                if x @ y / math.sqrt(x @ x * (y @ y)) >= 0.98:
                    pairs.append((a["vec_id"], b["vec_id"]))
    links = collections.Counter(x for p in pairs for x in p)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.9 * 2 * len(pairs) and all(got[i]["n_links"] <= links[i] for i in got)
    assert len(got) == 307 and all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (900, 901, 902, 903, 906)) and got[904]["n_links"] == 1
    if found == 2 * len(pairs):
        want = union(pairs, list(got))
        assert all(got[i]["component_id"] == want[i] for i in got)
    assert itq.near_duplicates(spark, vectors.limit(0)).count() == 0


def test_itq_recall_on_table(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    noisy = v.unionByName(v.select((F.col("vec_id") + 100_000).alias("vec_id"), F.transform("embedding", lambda x, i: x * (1 + F.sin(i * 7.0 + x * 99) / 12).cast("float")).alias("embedding"), "label"))
    rows = noisy.toPandas()
    want = 0
    for _, g in rows.groupby("label"):
        x = np.array(g["embedding"].tolist(), dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want += int((x @ x.T >= 0.98).sum()) - len(g)
    got = itq.near_duplicates(spark, noisy).agg(F.sum("n_links")).first()[0]
    assert want > 0 and got >= 0.9 * want and got <= want


def test_top_k_against_brute_force(spark, vectors):
    got = collections.defaultdict(list)
    for r in balltree.top_k(spark, vectors, vectors.where("vec_id % 100 = 0"), shard=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = {r["vec_id"]: [math.floor(1024 * x) for x in r["embedding"]] for r in vectors.collect() if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    for q in (i for i in rows if i % 100 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(rows[q], v, strict=False)), i) for i, v in rows.items() if i != q))[:10]
        assert got[q] == [(i, -s) for s, i in scores]
    assert balltree.top_k(spark, vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_odd_rows(spark):
    """Repeated ids, other lengths, zero vectors and components without squares, against Python's integers."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100, [1.0, 2.0]), (200, [1e306, -1e306, 1.0]), (300, [0.0] * 6), (7, [1e300] * 4), (8, [-1e200] * 4), (100, [3.0, 0.5, 1.0]), (9, [2.0**40] * 4), (400, None), (500, [1.0, None]), (600, [math.inf])]
    whole = [(i, [math.floor(x * 1024) if math.isfinite(x * 1024) else int(x) * 1024 for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (16, 10_000):
        got = collections.defaultdict(list)
        for r in balltree.top_k(spark, df, df.where("vec_id % 100 = 0"), shard=shard).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert set(got) == {0, 100, 200, 300}
        for q in got:
            asks = min(v for (i, _), v in zip([x for x in rows if x[0] in {y[0] for y in whole} and x[1]], [x[1] for x in whole], strict=False) if i == q)
            scores = sorted((-min(max(sum(a * b for a, b in zip(asks, v, strict=False)), -(2**63)), 2**63 - 1), i) for i, v in whole if i != q)[:10]
            assert got[q] == [(i, -s) for s, i in scores], (q, shard)


# -- lines ----------------------------------------------------------------------
def brute_lines(rows, least=0.8):
    """Places (row, line) of what goes, by all pairs; rows in order of their ids, null first."""
    out, seen = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    for at in order:
        for k, line in enumerate((rows[at][1] or "").split("\n")):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if not w:
                continue
            if any(len(w & s) >= least * len(w | s) - 1e-9 for s in seen):
                out.add((at, k))
            seen.append(w)
    return out


def removed_lines(digest):
    return {(r["doc_id"], int(k)) for r in digest.collect() for k in r["removed"].split(",") if k}


def test_lines_against_brute_force(spark, texts):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(14)]
    near = [(10_000 + i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i, k in enumerate(rng.integers(0, 14, 60).tolist())]
    short = [(20_000 + i, " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 5).tolist())) for i in range(80)]
    wide = [f"w{i}" for i in range(240)]
    long = [(30_000 + i, " ".join([*wide[: 200 + i], *(f"z{i}-{k}" for k in range(rng.integers(0, 60)))])) for i in range(30)]
    white = [(40_000, "A\tb\x0bc\x0cd  e\r"), (40_001, "a b c d e\n \t \n\x0c"), (40_002, "\u00c4pfel \u00d6l"), (40_003, "\u00e4pfel \u00f6l")]
    rows = [(i, t) for i, t in list(texts.items())[:60]] + near + short + long + white
    got = linededup.digest(*linededup.kept_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert removed_lines(got) == {(rows[at][0], k) for at, k in brute_lines(rows)}


def test_lines_beyond_the_broadcast_and_without_rarity(spark, texts, monkeypatch):
    rows = list(texts.items())[60:110]
    want = {(rows[at][0], k) for at, k in brute_lines(rows)}
    monkeypatch.setattr(linededup, "SENT", -1)
    monkeypatch.setattr(linededup, "ranks", lambda known, scratch: F.array_repeat(F.lit(0).cast("tinyint"), linededup.BUCKETS))
    got = linededup.digest(*linededup.kept_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert want and removed_lines(got) == want


def test_lines_odd(spark, odd, empty):
    rows, kept = linededup.kept_lines(spark, odd)
    cleaned = linededup.clean(rows, kept)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    assert cleaned.where("doc_id = 1 and text is null").count() == 1
    assert linededup.digest(*linededup.kept_lines(spark, empty)).count() == 0


@pytest.mark.parametrize("base, kind", [(0, "bigint"), (-(1 << 32), "bigint"), ((1 << 32) - 300, "bigint"), ((1 << 32) - 100, "decimal(38,0)"), (-(1 << 32) - 1, "decimal(38,0)"), (-(1 << 63), "decimal(38,0)"), ((1 << 63) - 300, "decimal(38,0)")])
def test_lines_by_ids_that_need_no_sort(spark, monkeypatch, base, kind):
    rng = np.random.default_rng(6)
    rows = [(base + i, "\n".join(" ".join(rng.choice([f"w{k}" for k in range(14)], 6).tolist()) for _ in range(2))) for i in range(200)] + [(base + 250, "\n \x0b\n\r\t")]
    made, keep = {}, common.Scratch.keep

    def kept(self, name, df, **options):
        made[name] = (dict(df.dtypes), df._jdf.queryExecution().sparkPlan().toString())
        return keep(self, name, df, **options)

    monkeypatch.setattr(common.Scratch, "keep", kept)
    got = linededup.digest(*linededup.kept_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert removed_lines(got) == {(rows[at][0], k) for at, k in brute_lines(rows)}
    assert made["sets"][0]["id"] == kind and not any("SortAggregate" in plan for _, plan in made.values())
    assert ("decimal" in made["sets"][1]) == (kind != "bigint")


def test_lines_by_few_reads_of_whole_sets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(9)]
    rows = [(i, "\n".join(white.join(rng.choice(words, n).tolist()) for n, white in zip(rng.integers(1, 8, 5).tolist(), "\t\x0b\x0c\r ", strict=True))) for i in range(120)]
    read, counted, keep, names = {}, {}, common.Scratch.keep, [linededup.FAST, linededup.TWO_LEVELS, linededup.LISTS]
    before = [spark.conf.get(n, None) for n in names]

    def kept(self, name, df, **options):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        read.setdefault(name, []).append(any(re.search(r"\bh#\d", line.split("]")[0]) for line in plan.splitlines() if "FileScan" in line))
        counted[name] = int(spark.conf.get(linededup.FAST, "16"))
        return keep(self, name, df, **options)

    monkeypatch.setattr(common.Scratch, "keep", kept)
    got = linededup.digest(*linededup.kept_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert removed_lines(got) == {(rows[at][0], k) for at, k in brute_lines(rows)}
    assert read["first"] == read["led"] == [False] and read["ranks"] == [True]
    assert 1 << counted["ranks"] >= linededup.BUCKETS and [spark.conf.get(n, None) for n in names] == before
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(2, "one two three"), (2, "one two three\nfour five six"), (None, "four five six"), (None, None), (1, "seven"), (3, "SEVEN\n\n")]
    found = linededup.digest(*linededup.kept_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["removed"]) for r in found.collect()) in [
        [("1", 1, ""), ("2", 1, first), ("2", 2, second), ("3", 3, "0"), ("None", 1, ""), ("None", 1, "")] for first, second in (("", "0,1"), ("0", "1"))
    ]
    texts = [r["text"] for r in linededup.clean(*linededup.kept_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    assert sorted(x or "" for x in texts) == sorted(["one two three", "", "", "four five six", "seven", "\n"])


# -- simhash --------------------------------------------------------------------
def brute_fp(t):
    w = words(t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark, texts):
    some = dict(list(texts.items())[:120]) | {900: None, 901: "", 902: "One two", 903: "one TWO"}
    d = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.classes(spark, d).collect()}
    fp = {i: brute_fp(t) for i, t in some.items()}
    assert all(got[i]["fp"] % 2**64 == f for i, f in fp.items())
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == union(pairs, list(fp))


def test_tiles_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    fps = sorted({int(b) for b in base} | set(near))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.link_edges(spark, spark.createDataFrame([(f,) for f in signed], "fp long"), tile=16).collect()
    have = union([(r[0], r[1]) for r in edges], signed)
    want = union([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4], signed)
    assert have == want and len(edges) < 40 * len(fps)


def test_simhash_odd(spark, odd, empty):
    assert simhash.classes(spark, odd).count() == 12 and simhash.classes(spark, empty).count() == 0


# -- language model ----------------------------------------------------------------
def brute_ctw(train, test, depth=lm_score.DEPTH):
    """log10 probabilities by walking every node of every depth, one bit at a time."""
    nodes = collections.defaultdict(lambda: [0, 0])

    def bits(text):
        raw = lm_score.PAD + b" ".join(lm_score.tokens(text)) + b"\n"
        for at in range(depth, len(raw)):
            done = 1
            for k in range(7, -1, -1):
                bit = raw[at] >> k & 1
                yield [(raw[at - d : at], done) for d in range(depth + 1)], bit
                done = done * 2 + bit

    kids = collections.defaultdict(set)
    for t in train:
        for path, bit in bits(t):
            for d, key in enumerate(path):
                nodes[key][bit] += 1
                if d:
                    kids[path[d - 1]].add(key)
    total, share = {}, {}
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        a, b = nodes[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        if len(key[0]) == depth:
            total[key], share[key] = own, 1.0
        else:
            below = sum(total[k] for k in kids[key])
            total[key] = float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + below))
            share[key] = math.exp(math.log(0.5) + own - total[key])
    out = []
    for t in test:
        s = 0.0
        for path, bit in bits(t):
            p, rest = 0.0, 1.0
            for key in path:
                if key not in nodes:
                    p, rest = p + rest / 2, 0.0
                    break
                a, b = nodes[key]
                p, rest = p + rest * share[key] * (b + 0.5) / (a + b + 1), rest * (1 - share[key])
            s += math.log10(p if bit else 1 - p)
        out.append(s)
    return out


def test_lm_against_brute_force(spark, texts):
    some = {i: (t or "")[:400] for i, t in list(texts.items())[:40]} | {5001: None, 5002: ""}
    got = {r["doc_id"]: r for r in lm_score.score(spark, spark.createDataFrame(list(some.items()), "doc_id long, text string")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in some}
    train = [t for i, t in some.items() if not held[i]]
    counts = collections.Counter(x for t in train for x in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = dict(zip(some, brute_ctw(train, list(some.values())), strict=True))
    for i, t in some.items():
        w = [*words(t), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], want[i], rel_tol=1e-5), i


def test_lm_tables():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 2**48, 5000))
    t = lm_score.Table(codes, np.arange(len(codes)))
    value, found = t.get(np.append(codes, [1, 2, 3]))
    assert found[:-3].all() and (value[:-3] == np.arange(len(codes))).all() and not found[-3:].any()
    x = np.array([0.5, 1.0, 7.25, 1e6])
    assert np.allclose(lm_score.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_lm_holds_few_texts_at_a_time():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, 200)) for _ in range(4000)] + [None, "", "x" * 900_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["rid", "doc_id", "text"])
    assert [x for p in lm_score.portions(batch.column(2)) for x in p] == texts
    assert [x for p in lm_score.portions(batch.column(2).slice(3990)) for x in p] == texts[3990:]
    codes, times = np.unique(lm_score.grams([lm_score.tokens(t) for t in texts]), return_counts=True)
    sent, head = (type("Sent", (), {"value": v}) for v in (lm_score.Table(codes, -np.ones(len(codes))), {f"w{x}".encode(): 1.0 for x in range(900)}))
    tracemalloc.start()
    scores = [r for b in lm_score.scorer(sent, head, 0, 1)([batch.slice(0, 4002)]) for r in b.column(7).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scores == [-float(len(b" ".join(lm_score.tokens(t))) + 1) for t in texts[:4002]] and peak < 40e6, peak
    *_, counted = lm_score.count_batches([pa.RecordBatch.from_arrays([batch.column(2)], names=["text"])])
    assert counted.column(1).to_pylist() == codes.tolist() and counted.column(2).to_pylist() == times.tolist()


def test_lm_odd(spark, odd, empty):
    out = lm_score.score(spark, odd).collect()
    assert len(out) == 12 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm_score.score(spark, empty).count() == 0


# -- secrets ------------------------------------------------------------------------
def test_secrets_plain(spark, docs, texts):
    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))

    for r in secret_scan.digest(secret_scan.scan(docs, keep=["doc_id"])).collect():
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]] or "").encode()).hexdigest()


def test_secrets_lexing():
    value = "Zx81kQpL0mVt9rBnW3yd"
    text = f'base = "{value}"\nclient_secret_value = base\ncolour: "{value[::-1]}"'
    got = secret_scan.scan_text(text)
    assert value in got["values"] and value[::-1] not in got["values"]
    assert secret_scan.scan_text('db_passphrase: "changeme-please"')["n_literal"] == 0
    assert secret_scan.name_parts("clientAPIKey_v2") == ["client", "api", "key", "v", "2"]
    loop = secret_scan.scan_text("a = b\nb = a\npassword = a")
    assert loop["n_literal"] == 0


@pytest.mark.parametrize("text, want", [
    ('config: credential = "@"', "@"), ('credential: str = "@"', "@"), ('credential = first = "@"', "@"), ('{"credential": "@", "x": 1}', "@"), ("export CREDENTIAL=@", "@"),
    ('credential = ("@1" \n   "@2")', '@1" \n   "@2'), ('credential = "@1" + "@2"', '@1" + "@2'), ('credential = "@1" \\\n "@2"', '@1" \\\n "@2'), ('credential = """@1\n@2"""', "@1\n@2"),
    ('credential = "@\\"x"', '@\\"x'), ('credential = b"@"', "@"), ("credential = base + '@'", "@"), ("it's said: don't; credential = '@'", "@"), ("// credential = '@'", "@"), ("see https://a.b/c?credential=@", "@"),
    ('colour = "@"', None), ('credential == "@"', None), ("credential = os.getenv('NAME')", None), ('credential = "${@}"', None),
])
def test_secrets_syntax(text, want):
    text, want = (x and x.replace("@", "Zx81kQpL0mVt9") for x in (text, want))
    assert secret_scan.scan_text(text)["values"] == ([want] if want else [])


def test_secrets_propagate_as_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        names = [f"n{i}" for i in range(12)]
        scores = dict(zip(names, rng.normal(size=12).tolist(), strict=True))
        sources = {n: {names[j] for j in rng.integers(0, 12, rng.integers(0, 3))} for n in names}
        into = {n: {t for t in names if n in sources[t]} for n in names}
        for n, got in secret_scan.reached(scores, sources).items():
            seen, todo = {n}, [n]
            while todo:
                new = into[todo.pop()] - seen
                seen |= new
                todo += new
            assert got == max(scores[x] for x in seen)
    spans, base = sorted((int(a), int(a + b)) for a, b in rng.integers(1, 60, (80, 2))), sorted((int(a), 0, int(a + b)) for a, b in rng.integers(1, 9, (6, 2)) * 7)
    assert secret_scan.uncovered(spans, base) == [s for s in spans if not any(b[0] < s[1] and s[0] < b[2] for b in base)]


def test_secrets_take_linear_time():
    n = 200_000
    chain = "\n".join(f"n{i} = n{i + 1}" for i in range(n)) + f'\nn{n} = "Zx81kQpL0mVt9"\nprivate_key = n0\n'
    start = time.process_time()
    assert secret_scan.scan_text(chain)["n_literal"] == 1
    assert secret_scan.scan_text("password=abcdefgh\n" * n)["n_assign"] == n
    for text in ("a=b+" * n, 'a="""' * n, "x=`" * n, "a=(' " * n, 'a="b" ' * n, "a='" + "\\'" * n, "a:b:" * n):
        secret_scan.scan_text(text)
    assert time.process_time() - start < 60


def test_secrets_of_any_length():
    part = hashlib.sha512(b"x").digest() + hashlib.sha512(b"y").digest()
    key = (base64.b64encode(part * 10).decode() * 2)[:1600]
    name = "very_" * 30 + "private_key"
    for text in (f'private_key = "{key}"', f"private_key = '{key}'", f"signing_key: {key[:900]}", f"credential{' ' * 12}={' ' * 12}{key[:40]}", f"{name} := {key[:40]}", f'auth_bearer\t\t=> "{key}"\n'):
        value = re.search(r"[A-Za-z0-9+/=]{40,}", text)
        assert secret_scan.scan_text(text)["spans"] == f"literal:{value.start()}:{value.end()}", text[:60]
    copied = secret_scan.scan_text(f'base = "{key}"\nclient_private_key = base')
    assert copied["values"] == [key]
    n = 200_000
    for text in ("a" * n, "a" + " " * n, "a=" * n, 'a="' * n, "a='x" * n, "private_key=" + " " * n, 'private_key="' + "<" * n + '"', 'private_key="' + "".join(map(chr, range(256, 50_000))) + '"'):
        start = time.process_time()
        secret_scan.scan_text(text)
        assert time.process_time() - start < 5


def test_secrets_odd(odd, empty):
    assert secret_scan.scan(odd, keep=["doc_id"]).count() == 12 and secret_scan.scan(empty).count() == 0
    assert "score" in secret_scan.scan(odd).columns


# -- packing --------------------------------------------------------------------------
def check_packing(rows, texts, window=1024):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    waste = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        waste += 0 if at & (at - 1) == 0 else window - at
    assert waste == 0


def test_packing_round_trip(spark, docs, texts):
    check_packing(packing.pack(spark, docs).collect(), texts)


def test_packing_odd(spark, odd, empty):
    some = odd.where("doc_id is not null and doc_id <> 4")
    check_packing(packing.pack(spark, some).collect(), {r["doc_id"]: r["text"] for r in some.collect()})
    assert packing.pack(spark, odd).count() >= 12 and packing.pack(spark, empty).count() == 0


def test_packing_counts_never_overdraw():
    hist = np.zeros(1024, dtype=np.int64)
    hist[[700, 324, 300, 400, 5]] = [1000, 10, 50, 7, 3]
    rows = packing.combinations(1024, hist)
    counts, left = packing.repeat_counts(rows, hist)
    assert (left >= 0).all() and (rows.sum(axis=1) == 1024).all() and counts.sum() >= 10


def test_coder_matches_library():
    c = packing.coder(None)
    for t in ("a  b", "x\n\ny", " lead", "trail ", "a\tb", "don't 's\nit's <|endoftext|> ok", "naïve wide", "foo\n bar", "", "\n", "café​z 漢字 1234,5", "a b c"):
        assert c.ids(t) == c.raw(t), t


# -- the queries and the pipeline ---------------------------------------------------------
def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def brute_mixture(rows, rate):
    """Ids kept of (doc_id, text, source, lang) by raking, levelling and drawing in plain Python."""
    where, n = {}, collections.Counter()
    for i, text, source, lang in rows:
        t = text or ""
        k = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        topic = "table" if " | " in t else "settings" if " = " in t or "{" in t else "contact" if "@" in t else "note" if k < 64 else "prose" if k < 512 else "long"
        where[i] = (source or "", lang or "", topic)
        n[where[i]] += k
    n = {c: k for c, k in n.items() if k}
    total = sum(n.values())
    share = lambda d, w: collections.Counter({v: sum(x for c, x in w.items() if c[d] == v) for v in {c[d] for c in w}})
    aims = []
    for d, power in enumerate((0.5, 0.7, 0.7)):
        raised = {v: (x / total) ** power for v, x in share(d, n).items()}
        aims.append({v: x / sum(raised.values()) for v, x in raised.items()})
    w = {c: k / total for c, k in n.items()}
    for _ in range(300):
        for d in range(3):
            have = share(d, w)
            w = {c: x * aims[d][c[d]] / have[c[d]] for c, x in w.items()}
    f, level = {c: w[c] * total / n[c] for c in n}, rate
    for _ in range(50):
        held = {c for c in n if f[c] * level >= 1}
        rest = sum(n[c] * f[c] for c in n if c not in held)
        level = (rate * total - sum(n[c] for c in held)) / rest if rest else level
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return {i for i, c in where.items() if draw(i) < min(1.0, f.get(c, math.inf) * level)}


def test_pipeline_stage_by_stage_against_brute_force(spark, sf):
    import corpus_pipeline as c

    scratch = common.Scratch(spark, "test")
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for name, stage in c.STAGES[:-1]:
        before = sorted(docs.collect(), key=lambda r: r["doc_id"])
        docs = scratch.keep(name.replace(" ", "_"), stage(spark, docs, sf))
        assert docs.columns == first.columns, name
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            z = {r["doc_id"]: toxicity.scores([r["text"]], model)[0] for r in before}
            want = {i for i, x in z.items() if x < c.TOXIC}
        elif name == "line dedup":
            gone = brute_lines([(r["doc_id"], r["text"]) for r in before])
            for at, r in enumerate(before):
                left = "\n".join(x for k, x in enumerate((r["text"] or "").split("\n")) if (at, k) not in gone)
                assert (got[r["doc_id"]]["text"] or "") == left and got[r["doc_id"]]["n_chars"] == (None if r["text"] is None else len(left))
            want = {r["doc_id"] for r in before}
        elif name == "simhash near-dedup":
            fp = {r["doc_id"]: brute_fp(r["text"]) for r in before}
            root = union([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], fp)
            want = {i for i, x in root.items() if i == x}
        else:
            want = brute_mixture([(r["doc_id"], r["text"], r["source"], r["lang"]) for r in before], c.KEEP)
        assert set(got) == want and docs.count() == len(want), name
        assert all(got[r["doc_id"]] == r for r in before if r["doc_id"] in got) or name == "line dedup"
    check_packing(c.STAGES[-1][1](spark, docs, sf).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert docs.count() > 0.4 * first.count()


def test_pipeline_keeps_null_and_repeated_ids(spark, sf):
    import corpus_pipeline as c

    text = " ".join(f"word{i}" for i in range(30))
    rows = [(None, "one of a kind, with no id at all", "en", "a", 1), (7, text, "en", "a", 1), (7, text, "en", "a", 1), (7, "another text under the same id", "en", "a", 1), (3, text.upper(), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in c.drop_copies(spark, docs, sf).collect()]
    assert sorted(left, key=str) == sorted([(None, rows[0][1]), (7, rows[3][1]), (3, text.upper())], key=str)
    assert c.mix(spark, docs.limit(0), sf).count() == 0 and c.mix(spark, docs, sf).columns == docs.columns


def test_pipeline_stages_take_empty_tables(spark, sf):
    import corpus_pipeline as c

    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, none, sf).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cursor = c.execute(queries.ORACLES[name])
    names = sorted(got.columns)
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    shown = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    assert sorted(tuple(shown(r[n]) for n in names) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in cursor.fetchall())


def test_own_shared_folder_is_set_once():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId = "test-app"

        def getConf(self):
            return Conf()

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        conf, sparkContext = Conf(), Context()

    root = common.shared_root(Session)
    assert root == common.shared_root(Session) == Session.sparkContext.path


def test_cluster_without_a_shared_folder_is_refused():
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://host", "local", "local[4]", "local[*, 2]"):
        conf = {"spark.master": master}
        context = type("Context", (), {"applicationId": f"test-{master}", "getConf": lambda self, c=conf: c, "setCheckpointDir": lambda self, path: None})
        session = type("Session", (), {"conf": {}, "sparkContext": context()})
        if master.split("[")[0] == "local":
            assert common.shared_root(session).startswith("file:///")
        else:
            with pytest.raises(ValueError):
                common.shared_root(session)
