"""Operator 6: approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts (recursive bisection by the graph's
slowest-varying vector at its median, then swaps that shorten the cut). A small classifier learns which
parts a vector's neighbours lie in. Every row is indexed under its most probable part; a query is sent
to its most probable parts until their probabilities add up to what the held-out part of the sample needs
for the recall asked for, and until they hold enough rows. There it is ranked on the original vectors, in
double precision, against every row of the part.

Parts and sample grow with the number of rows (`PART_ROWS` rows a part, `SAMPLED` sample rows a part, up to
`MOST_PARTS` parts): with vectors of some structure, a query meets a number of rows that stays the same.
Sample, graph and classifier live on the driver, at most SAMPLED * MOST_PARTS vectors. Rows are dealt out by
part; both a part's rows and the queries sent to it are cut into blocks of bounded size, so a group of equal
vectors shares a part, not a task. Blocks return each query's best, which are merged by query. A query that
still found fewer than k, because rows of its own id filled its parts, is ranked against all rows.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
another length than most. Rows with the same id count as one row each; a query never meets its own
id. Rows without an id take no part. Fewer candidates than asked for are all returned. Only id and vector
are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import discard, materialize, table

#: Rows of a part as far as parts may grow in number, sample rows of each, most parts, and neighbours in the graph.
PART_ROWS, SAMPLED, MOST_PARTS, GRAPH = 1024, 64, 512, 12
#: The least sample, and the least parts.
SAMPLE, PARTS = 4096, 32
#: Rows and queries that one task compares at a time.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Share of the sample's neighbours that the parts visited must hold.
RECALL = 0.96

Edges = tuple[np.ndarray, np.ndarray]


def nearest(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Each query's k nearest rows by inner product, but for the row numbered `own`, in any order."""
    out = np.zeros((len(q), k), dtype=np.int64)
    for a in range(0, len(q), 512):
        s = q[a : a + 512] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[a : a + 512]] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def neighbour_graph(x: np.ndarray, k: int) -> Edges:
    """Both ends of every edge between a row and one of its k nearest others, each edge in both directions."""
    k = min(k, len(x) - 1)
    near = nearest(x, x, k, np.arange(len(x))) if k > 0 else np.zeros((len(x), 0), dtype=np.int64)
    a, b = np.repeat(np.arange(len(x)), k), near.reshape(-1)
    both = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]))
    return both // len(x), both % len(x)


def bisect(edges: Edges, n: int, rounds: int = 40) -> np.ndarray:
    """One half of the nodes as True: the signs around the median of the second eigenvector, improved by
    swapping the nodes that gain most."""
    a, b = edges
    total = lambda v: np.bincount(a, weights=v[b], minlength=n)
    scale = 1 / np.sqrt(np.bincount(a, minlength=n) + 1)
    flat = 1 / scale / np.linalg.norm(1 / scale)
    v = np.cos(np.arange(n) * 2.399963)
    for _ in range(rounds):
        v = v - flat * (flat @ v)
        v = scale * total(scale * v) + scale * scale * v + v
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v * scale, kind="stable")[n // 2 :]] = True
    cut = lambda: int((side[a] != side[b]).sum())
    least = cut()
    for _ in range(20):
        pull = total(np.where(side, 1.0, -1.0))
        gain = np.where(side, -pull, pull)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = max(1, min(len(one), len(two)) // 50)
        one, two = one[:m], two[:m]
        good = gain[one] + gain[two] > 0
        if not good.any():
            break
        side[one[good]], side[two[good]] = False, True
        if (now := cut()) >= least:
            side[one[good]], side[two[good]] = True, False
            break
        least = now
    return side


def partition(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row; sizes differ by as little as halving allows."""
    label = np.zeros(len(x), dtype=np.int64)
    count = 1
    while count < parts and len(x) >= 4 * count:
        new = label * 2
        for p in range(count):
            rows = np.flatnonzero(label == p)
            if len(rows) > 1:
                new[rows] += bisect(neighbour_graph(x[rows], GRAPH), len(rows))
        label, count = new, count * 2
    return label


class Router:
    """A network of one hidden layer from a vector to its parts' probabilities."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 64, rounds: int = 150, rate: float = 0.01):
        rng = np.random.default_rng(7)
        d, k = x.shape[1], target.shape[1]
        self.scale = np.sqrt(d) / (np.sqrt((x**2).sum(axis=1)).mean() + 1e-30)
        w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, k)), np.zeros(k), np.zeros((d, k))]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        x = x * self.scale
        for t in range(1, rounds + 1):
            h = np.maximum(x @ w[0] + w[1], 0)
            p = _softmax(h @ w[2] + x @ w[4] + w[3])
            e = (p - target) / len(x)
            back = (e @ w[2].T) * (h > 0)
            for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0), x.T @ e)):
                g = g + 1e-4 * w[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                w[i] = w[i] - rate * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        w = self.w
        return _softmax(np.maximum(x @ w[0] + w[1], 0) @ w[2] + x @ w[4] + w[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def parts_for(n: int) -> int:
    """How many parts n rows get: a power of two."""
    return min(MOST_PARTS, max(PARTS, 1 << max(0, (n // PART_ROWS).bit_length() - 1)))


def learn(x: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL) -> tuple[Router | None, float]:
    """The router, and what the probabilities of the parts that a query visits must add up to. Too small a
    sample has one part."""
    if len(x) < 8 * parts:
        return None, 1.0
    label = partition(x, parts)
    k = min(k, len(x) - 2)
    near = nearest(x, x, k, np.arange(len(x)))
    target = 0.5 * np.eye(parts)[label]
    np.add.at(target, (np.arange(len(x))[:, None], label[near]), 0.5 / k)
    # Learned on three quarters, how far a query goes chosen on the rest.
    held = np.arange(len(x)) % 4 == 3
    router = Router(x[~held], target[~held])
    at = router(x).argmax(axis=1)
    p = router(x[held])
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.zeros_like(p)
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, axis=1), axis=1), axis=1)
    # What the parts more probable than a neighbour's own add up to.
    needed = np.sort((before - p)[np.arange(len(p))[:, None], at[near[held]]].reshape(-1))
    return router, float(needed[int(recall * (len(needed) - 1))])


def visited(p: np.ndarray, sizes: np.ndarray, enough: float, k: int) -> list[np.ndarray]:
    """The parts that each query visits: the most probable ones until those before them add up to more than
    `enough`, two at least, and on until they hold more than k rows."""
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    rows = np.cumsum(sizes[order], axis=1) - sizes[order]
    go = (before <= enough) | (rows <= k)
    go[:, :2] = True
    # Parts without rows are passed over.
    return [o[g & (sizes[o] > 0)].astype(np.int32) for o, g in zip(order, go, strict=True)]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = rows.where((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best rows, ties to the smaller id. Scores are summed in one fixed order, so equal
    vectors get equal scores wherever they stand."""
    out_q, out_x, out_s = [], [], []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[qid[a : a + 256, None] == xid[None, :]] = -np.inf
        n = min(k, s.shape[1])
        last = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        for i in range(len(s)):
            rows = np.flatnonzero(s[i] >= last[i] - 1e-9 * (1 + abs(last[i]))) if np.isfinite(last[i]) else np.flatnonzero(np.isfinite(s[i]))
            exact = (x[rows] * q[a + i]).sum(axis=1)
            top = np.lexsort((xid[rows], -exact))[:k]
            out_q += [qid[a + i]] * len(top)
            out_x += xid[rows[top]].tolist()
            out_s += exact[top].tolist()
    return pd.DataFrame({"query_id": np.array(out_q, dtype=np.int64), "vec_id": np.array(out_x, dtype=np.int64), "score": np.array(out_s, dtype=float)})


def search(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `is_query` (a function of
    the id column) holds."""
    rows = usable(df, id_col, vector_col)
    n = rows.count()
    parts = parts_for(n)
    size = max(SAMPLE, SAMPLED * parts)
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < int(min(1.0, 1.3 * size / max(n, 1)) * 1_000_000_000) + 1
    got = rows.where(share).select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(size).collect()
    router, enough = learn(np.array([r["v"] for r in got]), k, parts, recall) if got else (None, 1.0)
    parts = parts if router else 1

    def place(batches):
        for b in batches:
            p = router(np.stack(b["v"].to_numpy())).argmax(axis=1) if router and len(b) else np.zeros(len(b))
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "part": p.astype(np.int32)})

    placed = materialize(rows.mapInPandas(place, "id long, v array<double>, part int"), "placed")
    sizes = np.zeros(parts, dtype=np.int64)
    for r in placed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    def send(batches):
        for b in batches:
            to = visited(router(np.stack(b["v"].to_numpy())), sizes, enough, k) if router and len(b) else [np.zeros(1, np.int32)] * len(b)
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "parts": to})

    sent = placed.where(is_query(F.col("id"))).select("id", "v").mapInPandas(send, "id long, v array<double>, parts array<int>")
    found = materialize(_ranked(placed, sent, sizes, k), "found")
    # Queries whose parts did not have enough rows of other ids go to all parts.
    other = n - 1 if n else 0
    short = placed.where(is_query(F.col("id"))).select("id").distinct().join(found.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(F.coalesce("count", F.lit(0)) < min(k, other)).select("id")
    short = materialize(short, "short")
    if parts > 1 and short.count():
        every = placed.where(is_query(F.col("id"))).join(short, "id").select("id", "v", F.sequence(F.lit(0), F.lit(parts - 1)).alias("parts"))
        found = found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(_ranked(placed, every, sizes, k))
    else:
        discard(placed)
    return found


def _ranked(placed: DataFrame, sent: DataFrame, sizes: np.ndarray, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query against all rows of the parts that it is sent to."""
    sent = materialize(sent.select("id", "v", F.explode("parts").alias("part")), "sent")
    asked = np.zeros(len(sizes), dtype=np.int64)
    for r in sent.groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    of = lambda counts, most: F.element_at(F.array(*[F.lit(int(max(1, -(-c // most)))) for c in counts]), F.col("part") + 1)
    blocks, cuts = of(sizes, BLOCK_ROWS), of(asked, BLOCK_QUERIES)
    upto = lambda m: F.explode(F.sequence(F.lit(0), (m - 1).cast("int")))
    mine = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
    items = placed.select("id", "v", "part", mine(blocks).alias("block")).select("*", upto(cuts).alias("cut"))
    queries = sent.select("id", "v", "part", mine(cuts).alias("cut")).select("*", upto(blocks).alias("block"))

    def rank(_, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return best(np.stack(q["v"].to_numpy()), q["id"].to_numpy(), np.stack(x["v"].to_numpy()), x["id"].to_numpy(), k)

    keys = ("part", "block", "cut")
    found = queries.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
