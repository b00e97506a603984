"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

Vectors get one more element that makes their norms equal, so that the largest inner product is the smallest
distance. The tree is fitted on a bounded sample of SAMPLE vectors (those first by a hash of id and vector); every row is then put
in the leaf it descends to. A query visits leaves best bin first: a priority queue holds unvisited branches by distance to their
centres. How many leaves are visited is widened on sampled queries until TARGET recall among the sample is reached;
leaves of the whole table hold closer neighbours than those of the sample, so recall there isn't lower as a rule. Sampled queries are searched as all are.
A query goes on until the leaves it visits hold enough rows for its answer.

Neighbouring small leaves share a shelf of about BLOCK rows, a large leaf is split into blocks of as many. A block gets each query that
visits a leaf of it once, compares it with the rows of the leaves it visits, and gives its best. The best of all blocks are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import written

SAMPLE = 20_000
BRANCHES = 8
LEAF = 48
ROUNDS = 12
#: Sampled queries that widening is calibrated on, and the recall it aims at.
PROBES, TARGET = 300, 0.97
BLOCK = 4096
#: Queries that a block compares at once, and that a task gets with a block; more come in several parts.
TOGETHER, QUERIES = 1024, 8192


@dataclass
class Tree:
    """Nodes in one list; a leaf has no children. ``centres`` by node."""

    children: list[list[int]]
    centres: np.ndarray
    leaf: list[int]
    visits: int = 1

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = _distances(x[rows], self.centres[kids]).argmin(axis=1)
            todo += [(int(kids[k]), rows[near == k]) for k in range(len(kids)) if (near == k).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in the order in which the queue gives them: so many, and more until they hold ``least`` of the ``rows`` by leaf."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or rows is not None and held < least):
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                d = ((self.centres[kids] - q) ** 2).sum(axis=1)
                first = int(d.argmin())
                for k, kid in enumerate(kids):
                    if k != first:
                        heapq.heappush(queue, (float(d[k]), kid))
                node = kids[first]
            out.append(self.leaf[node])
            held += rows.get(out[-1], 0) if rows is not None else 0
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1)[None, :] - 2 * x @ c.T


def _means(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Centres of k-means; fewer than BRANCHES if there are fewer distinct vectors."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        near = _distances(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def grow(x: np.ndarray, seed: int = 11) -> Tree:
    rng = np.random.default_rng(seed)
    children, centres, leaf, todo, leaves = [[]], [x.mean(axis=0)], [-1], [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        near, means = np.zeros(len(rows), np.int64), None
        if len(rows) > LEAF:
            means = _means(x[rows], rng)
            near = _distances(x[rows], means).argmin(axis=1)
        parts = [k for k in range(near.max() + 1) if (near == k).any()] if len(rows) else []
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for k in parts:
            children[node].append(len(children))
            todo.append((len(children), rows[near == k]))
            children.append([])
            centres.append(means[k])
            leaf.append(-1)
    return Tree(children, np.array(centres), leaf)


def _asked(v: np.ndarray, most: float) -> np.ndarray:
    """Queries as the tree is searched for them: of the common norm, which leaves the order of inner products as it is, and 0 in the added element."""
    norms = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.column_stack((v * (np.sqrt(most) / np.maximum(norms, 1e-300)), np.zeros(len(v))))


def calibrated(tree: Tree, x: np.ndarray, k: int, most: float) -> Tree:
    """Widen the visits until the mean recall of sampled queries, searched like any other, is TARGET; all leaves if it stays lower."""
    leaf = tree.descend(x)
    missing = []
    for i in range(0, len(x), max(1, len(x) // PROBES)):
        d = -(x[:, :-1] @ x[i, :-1])
        d[i] = np.inf
        top = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        order = {b: n for n, b in enumerate(tree.best_bins(_asked(x[i : i + 1, :-1], most)[0], tree.leaves))}
        missing.append([order[b] for b in leaf[top]])
    ranks = np.sort(np.concatenate([np.array(m, float) for m in missing])) if missing else np.zeros(1)
    tree.visits = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1 if len(ranks) else tree.leaves
    return tree


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more element, so that every norm is ``most``."""
    return np.column_stack((x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part: not null, not zero, finite, of the commonest length."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0].n) if sizes else rows


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fitted(rows: DataFrame, k: int) -> tuple[Tree, float] | None:
    """The tree and the largest squared norm; None for an empty table."""
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    if most is None:
        return None
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    x = _lifted(_matrix(sample), most)
    return calibrated(grow(x), x, k, most), most


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, visited: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The best of a block for each query, among the rows in leaves that it visits: number of the query, rows, inner products summed in order."""
    for a in range(0, len(q), TOGETHER):
        rough = q[a : a + TOGETHER] @ x.T
        for i, s in enumerate(rough):
            keep = np.flatnonzero((ids != own[a + i]) & visited[a + i])
            if len(keep) > k:  # those that rounding might put among the k best
                cut = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                keep = keep[s[keep] >= cut - 1e-9 * max(1.0, abs(cut))]
            exact = np.cumsum(x[keep] * q[a + i], axis=1)[:, -1] if len(keep) else np.zeros(0)
            order = np.lexsort((ids[keep], -exact))[:k]
            yield a + i, keep[order], exact[order]


def _shelves(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Shelf and number of blocks of each leaf: neighbouring small leaves share a shelf of about BLOCK rows, a large leaf has its own
    and is split into blocks."""
    out, shelf, held = {}, 0, 0
    for leaf in sorted(counts):
        if held and held + counts[leaf] > BLOCK:
            shelf, held = shelf + 1, 0
        out[leaf] = shelf, max(1, -(-counts[leaf] // BLOCK))
        held += counts[leaf]
    return out


def nearest(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the nearest found for each query, largest inner product first.

    ``queries`` has the columns of ``vectors``. Null, zero, partly null and non-finite vectors, vectors of another length than
    most and rows without an id take no part, in neither table. Rows with the query's id are no candidates; other repeated rows each are
    one. Queries repeated with the same vector count once. Ties go to the smaller id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    found = fitted(rows, k)
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if found is None:
        return spark.createDataFrame([], out)
    tree, most = found

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.descend(_lifted(_matrix(batch.column(1)), most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "leaf"])

    placed = written(rows.mapInArrow(place, "id bigint, v array<double>, leaf bigint"), "leaves")
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row for each leaf of the tree
    own = placed.groupBy("id").count().agg(F.max("count")).first()[0]  # rows that a query may find but not take
    shelves = _shelves(counts)
    sizes = spark.createDataFrame([(leaf, *shelf) for leaf, shelf in shelves.items()], "leaf bigint, shelf bigint, blocks bigint")
    in_blocks = placed.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks"))).drop("blocks")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = _asked(_matrix(batch.column(1)), most)
                visits = []
                for x in q:
                    by: dict[tuple[int, int], list[int]] = {}
                    for leaf in tree.best_bins(x, tree.visits, counts, k + own):
                        if leaf in shelves:
                            by.setdefault(shelves[leaf], []).append(leaf)
                    visits.append([{"shelf": s, "blocks": n, "leaves": leaves} for (s, n), leaves in by.items()])
                kind = pa.list_(pa.struct([("shelf", pa.int64()), ("blocks", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, kind)], names=["id", "v", "visits"])

    asked = usable(queries, vec_id, vector).where(F.size("v") == tree.centres.shape[1] - 1).dropDuplicates(["id", "v"])
    visiting = asked.mapInArrow(visit, "id bigint, v array<double>, visits array<struct<shelf:bigint,blocks:bigint,leaves:array<bigint>>>")
    visiting = visiting.select("id", "v", F.inline("visits")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "q": "int64", "vec_id": "int64", "score": "float64"})
        x, ids, q, own = np.stack(left["v"]), left["id"].to_numpy(), np.stack(right["v"]), right["id"].to_numpy()
        leaves, leaf = np.unique(left["leaf"].to_numpy(), return_inverse=True)
        visited = np.stack([np.isin(leaves, wanted) for wanted in right["leaves"]])[:, leaf]
        parts = [(np.full(len(at), own[i]), np.full(len(at), right["q"].iat[i]), ids[at], s) for i, at, s in _best(x, ids, q, own, visited, k)]
        return pd.DataFrame({name: np.concatenate([p[j] for p in parts]) for j, name in enumerate(("query_id", "q", "vec_id", "score"))})

    keys = ["shelf", "block", "part"]
    parts_of_queries = max(1, -(-asked.count() // QUERIES))
    in_blocks = in_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of_queries - 1))))
    right = visiting.withColumn("q", F.xxhash64("v")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts_of_queries)).cast("int"))
    some = in_blocks.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id bigint, q bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
