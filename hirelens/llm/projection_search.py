"""Nearest neighbours through low-dimensional stable projections and a kd-tree.

Vectors are lifted so that the largest inner product becomes the smallest Euclidean distance
(one more coordinate brings all candidates to the same norm) and projected on ``DIMS`` Gaussian
directions. The projections are split by a kd-tree: its upper levels, fitted on a bounded sample, cut
space into cells that are the units of distribution; inside a cell the tree goes on down to leaves.

A query opens leaves in order of their projected distance and verifies their vectors on the original
components. The squared projected distance of a point at distance d is d^2 times a chi-squared variable with DIMS
degrees of freedom, so once the next leaf lies beyond d_k^2 * quantile(CONFIDENCE), with d_k the
distance of the k-th best so far, a better neighbour is among the rest with little probability, and the search stops.

First each query searches its own cell; the k-th distance found there says which other cells the
stopping test leaves open, and only to these it is sent. Cells hold about ``CELL_ROWS`` vectors (those that
copies overfill are split by id), and a cell meets its queries in blocks of ``QUERY_BLOCK``, so tasks are of bounded size.

* Vectors that are null, zero, hold null or non-finite components, or are not of the most frequent length take no part.
* Rows of one vec_id are candidates each; a query leaves out every row of its own id. Null ids take no part.
* Fewer than k candidates: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMS = 6
CONFIDENCE_QUANTILE = {0.9: 10.645, 0.95: 12.592, 0.99: 16.812}  # of chi-squared with 6 degrees of freedom
CONFIDENCE = 0.95
SAMPLE = 1 << 14
CELL_ROWS = 4096
MAX_CELLS = 1 << 12
LEAF = 128
QUERY_BLOCK = 1024
K = 20
SEED = 7


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of double) of the vectors that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


class Projection:
    """Lift and project. Points and queries share the directions."""

    def __init__(self, dim: int, norm2: float):
        self.norm2 = norm2
        self.directions = np.random.default_rng(SEED).normal(size=(dim + 1, DIMS))

    def points(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return x @ self.directions[:-1] + lift[:, None] * self.directions[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions[:-1]

    def distance2(self, q: np.ndarray, ip: np.ndarray | float) -> np.ndarray | float:
        """Squared lifted distance of a candidate with that inner product."""
        return (q * q).sum(axis=-1) + self.norm2 - 2 * ip


class Tree:
    """Cells of the upper levels: median splits along the widest side, and the boxes they leave."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.split: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; negative: cell -1 - number
        self.low, self.high = [], []
        inf = np.full(DIMS, np.inf)

        def build(rows: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
            if n == 1 or len(rows) < 2 or np.ptp(rows, axis=0).max() == 0:
                self.low.append(low), self.high.append(high)
                return -len(self.low)
            dim = int(np.ptp(rows, axis=0).argmax())
            value = float(np.median(rows[:, dim]))
            left = rows[:, dim] < value
            if not left.any():
                value = float(rows[rows[:, dim] > value, dim].min())
                left = rows[:, dim] < value
            at = len(self.split)
            self.split.append((dim, value, 0, 0))
            cut_high, cut_low = high.copy(), low.copy()
            cut_high[dim] = cut_low[dim] = value
            a = build(rows[left], n // 2, low, cut_high)
            b = build(rows[~left], n - n // 2, cut_low, high)
            self.split[at] = (dim, value, a, b)
            return at

        self.root = build(sample, cells, -inf, inf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def cell(self, p: np.ndarray) -> np.ndarray:
        out = np.empty(len(p), np.int64)
        stack = [(self.root, np.arange(len(p)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                dim, value, a, b = self.split[node]
                left = p[rows, dim] < value
                stack += [(a, rows[left]), (b, rows[~left])]
        return out

    def reach2(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance from each point to each cell's box."""
        return box2(p, self.low, self.high)


def box2(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(p), len(low)))
    for d in range(p.shape[1]):
        x = p[:, d][:, None]
        gap = np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0)
        out += gap * gap
    return out


def leaves(p: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of a cell's leaves: the tree below the cell, down to ``size`` rows."""
    out, stack = [], [np.arange(len(p))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        dim = int(np.ptp(p[rows], axis=0).argmax())
        order = rows[np.argsort(p[rows, dim], kind="stable")]
        stack += [order[: len(rows) // 2], order[len(rows) // 2:]]
    return out


def search_cell(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, limit: np.ndarray, proj: Projection,
                k: int = K, confidence: float = CONFIDENCE) -> tuple[np.ndarray, ...]:
    """Positions of queries, ids and inner products of the up to k best rows of a cell for each query.
    ``limit``: the squared distance of the k-th best that the query has from elsewhere."""
    p, pq = proj.points(x), proj.queries(q)
    rows = leaves(p)
    low, high = np.array([p[r].min(axis=0) for r in rows]), np.array([p[r].max(axis=0) for r in rows])
    order = np.concatenate(rows)
    ids, x = ids[order], np.ascontiguousarray(x[order])
    ends = np.cumsum([len(r) for r in rows])
    starts = ends - [len(r) for r in rows]
    reach = box2(pq, low, high)
    quantile = CONFIDENCE_QUANTILE[confidence]
    who, found, value = [], [], []
    for i in range(len(q)):
        queue = np.argsort(reach[i], kind="stable")
        own, kth = limit[i], limit[i]
        base = float((q[i] * q[i]).sum()) + proj.norm2
        best_ip, best_at = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 2
        while at < len(queue):
            open_ = queue[at:at + step]
            open_ = open_[reach[i, open_] <= kth * quantile]  # the stopping test, on the next leaves
            if not len(open_):
                break
            bar = (base - min(own, kth)) / 2 - 1e-9  # only these inner products can matter
            near = np.concatenate([starts[j] + np.flatnonzero(x[starts[j]:ends[j]] @ q[i] >= bar) for j in open_])
            near = near[ids[near] != qids[i]]
            best_ip = np.concatenate([best_ip, (x[near] * q[i]).sum(axis=1)])  # summed alike wherever a row lies
            best_at = np.concatenate([best_at, near])
            if len(best_ip) > k:
                top = np.lexsort((ids[best_at], -best_ip))[:k]
                best_ip, best_at = best_ip[top], best_at[top]
            if len(best_ip) >= k:
                kth = min(own, base - 2 * best_ip.min())
            at += step
            step = min(step * 2, 16)
        who.append(np.full(len(best_at), i)), found.append(ids[best_at]), value.append(best_ip)
    return np.concatenate(who), np.concatenate(found), np.concatenate(value)


def stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = 20,
            confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row whose id is divisible by ``every``,
    among all other rows, by inner product, largest first, ties to the smaller id."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialize(usable(vectors, id_col, vec_col), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(norm).alias("norm2")).first()
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    proj = Projection(facts["d"], facts["norm2"])
    cells = min(MAX_CELLS, max(1, -(-facts["n"] // CELL_ROWS)))
    sample = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).toPandas()  # the sample the index is fitted on
    tree = Tree(proj.points(stack(sample["v"])), cells)
    held = spark.sparkContext.broadcast((proj, tree))  # MAX_CELLS boxes

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proj, tree = held.value
        for b in batches:
            yield b.assign(cell=tree.cell(proj.points(stack(b["v"]))))

    placed = materialize(rows.mapInPandas(place, "id long, v array<double>, cell long"), "placed")
    loads = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL_ROWS)).alias("parts"))  # MAX_CELLS rows at most
    points = (placed.join(F.broadcast(loads), "cell")
              .select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "v"))
    queries = placed.where(F.col("id") % every == 0)

    def meet(asked: DataFrame, label: str) -> DataFrame:
        """asked(id, v, cell, limit) searched in their cells -> id, found, ip."""
        asked = materialize(asked, "asked")
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))  # MAX_CELLS rows at most
        # a task for each part of a cell and each block of the queries that come to it
        left = (points.join(F.broadcast(blocks), "cell")
                .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks"))
        right = (asked.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
                 .join(F.broadcast(loads), "cell")
                 .select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block", "id", "v", "limit"))

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": [], "found": [], "ip": []}).astype({"query": "int64", "found": "int64"})
            proj, _ = held.value
            ids = b["id"].to_numpy(np.int64)
            who, found, ip = search_cell(a["id"].to_numpy(np.int64), stack(a["v"]), ids, stack(b["v"]), b["limit"].to_numpy(float), proj, k, confidence)
            return pd.DataFrame({"query": ids[who], "found": found, "ip": ip})

        keys = ["cell", "part", "block"]
        return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query long, found long, ip double"), label)

    home = meet(queries.withColumn("limit", F.lit(float("inf"))), "home")
    kth = best(home, k).groupBy("query").agg(F.max("rank").alias("n"), F.min("ip").alias("kth"))
    known = queries.join(kth, queries["id"] == kth["query"], "left").select("id", "v", "cell", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proj, tree = held.value
        quantile = CONFIDENCE_QUANTILE[confidence]
        for b in batches:
            v = stack(b["v"])
            if not len(b):
                continue
            kth = b["kth"].to_numpy(float)
            limit = np.where(np.isnan(kth), np.inf, proj.distance2(v, np.nan_to_num(kth)))
            reach = tree.reach2(proj.queries(v))
            reach[np.arange(len(b)), b["cell"].to_numpy(np.int64)] = np.inf  # searched already
            i, c = np.nonzero((reach <= (limit * quantile)[:, None]) & np.isfinite(reach))
            yield pd.DataFrame({"id": b["id"].to_numpy(np.int64)[i], "v": b["v"].to_numpy()[i], "cell": c, "limit": limit[i]})

    rest = meet(known.mapInPandas(elsewhere, "id long, v array<double>, cell long, limit double"), "rest")
    return best(home.union(rest), k).select(F.col("query").alias("query_id"), "rank", F.col("found").alias("vec_id"), F.col("ip").alias("score"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. A query has at most k rows from a cell."""
    w = Window.partitionBy("query").orderBy(F.desc("ip"), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
