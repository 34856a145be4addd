"""Approximate nearest neighbours: hierarchical k-means tree, best bin first, calibrated visits."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .vectors import best_rows, first_of_alike, matrix, most_common_dimension

#: Rows, by smallest hash of the id, that the tree is fitted on; all rows are indexed.
SAMPLE = 20_000
#: Children of a node, and sampled rows under which a node is a leaf.
BRANCHES, LEAF = 8, 64
#: Queries, by smallest hash of the id, whose true neighbours set the number of leaves visited.
CALIBRATION = 256
RECALL = 0.95
#: Candidates and queries that meet in one group; larger leaves are parted.
PART, QUERIES = 4096, 1024


@dataclass
class Tree:
    """Nodes in order of creation: the children's numbers and centres; a leaf has its own number."""

    children: list[np.ndarray | None]
    centers: list[np.ndarray | None]
    leaf: list[int]
    leaves: int

    @classmethod
    def grow(cls, x: np.ndarray, branches: int = BRANCHES, size: int = LEAF, seed: int = 7) -> Tree:
        rng = np.random.default_rng(seed)
        tree = cls([None], [None], [-1], 0)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = _k_means(x[rows], branches, rng) if len(rows) > size else None
            if parts is None:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
                continue
            centers, label = parts
            numbers = np.arange(len(tree.leaf), len(tree.leaf) + len(centers))
            tree.children[node], tree.centers[node] = numbers, centers
            for i, n in enumerate(numbers):
                tree.children.append(None)
                tree.centers.append(None)
                tree.leaf.append(-1)
                todo.append((int(n), rows[label == i]))
        return tree

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every node on the way down."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.leaf[node]
            elif len(rows):
                label = _distances(x[rows], self.centers[node]).argmin(axis=1)
                todo += [(int(n), rows[label == i]) for i, n in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for one query, best bin first.

        A queue holds nodes seen and not yet opened, the nearest centre on top; opening
        an inner node queues its children, opening a leaf visits it.
        """
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            numbers = self.children[node]
            if numbers is None:
                found.append(self.leaf[node])
                continue
            for d, n in zip(_distances(q[None], self.centers[node])[0].tolist(), numbers.tolist(), strict=True):
                heapq.heappush(queue, (d, n))
        return found


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less each row's own square, which ranks centres alike."""
    return np.square(centers).sum(axis=1) - 2 * x @ centers.T


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres and labels of two non-empty clusters at least; None if the rows are all alike."""
    centers = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        label = _distances(x, centers).argmin(axis=1)
        used = np.unique(label)
        centers = np.array([x[label == i].mean(axis=0) for i in used])
    label = _distances(x, centers).argmin(axis=1)
    used = np.unique(label)
    return (centers[used], np.searchsorted(used, label)) if len(used) > 1 else None


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate gives all rows the length ``longest``; the largest inner product
    with a query (whose further coordinate is 0) then is the smallest distance."""
    rest = np.sqrt(np.maximum(0, longest**2 - np.square(x).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def _raised(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries brought to the length ``longest``, which leaves their ranking as it is."""
    return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True) * longest, np.zeros((len(q), 1))])


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (doubles): not null, not zero, of finite components."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def _top(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, c: np.ndarray, k: int) -> pa.Table:
    """Each query's k best among the candidates, its own id left out."""
    q_ids, q = queries
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ c.T
        for i, row in enumerate(s, at):
            other = np.flatnonzero(ids != q_ids[i])
            best = other[best_rows(ids[other], row[other], k)]
            out.append((np.full(len(best), q_ids[i]), ids[best], row[best]))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


_HITS = "query_id long, vec_id long, score double"


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(queries: tuple[np.ndarray, np.ndarray], candidates: DataFrame, k: int) -> DataFrame:
    """A bounded set of queries against all candidates: each task sends k rows a query."""
    sent = candidates.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from _top(sent.value, b.column(0).to_numpy(), matrix(b.column(1)), k).to_batches()

    return _ranked(candidates.select("id", "v").mapInArrow(run, _HITS), k)


def calibrated_visits(tree: Tree, queries: tuple[np.ndarray, np.ndarray], longest: float, truth: list[tuple[int, int]], target: float) -> int:
    """The fewest leaves that hold ``target`` of the true neighbours, given as (query, leaf)."""
    order = {q: {leaf: i for i, leaf in enumerate(tree.visit(v, tree.leaves))} for q, v in zip(queries[0].tolist(), _raised(queries[1], longest), strict=True)}
    places = np.sort([order[q][leaf] for q, leaf in truth])
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1 if len(places) else tree.leaves


def nearest(
    rows: DataFrame,
    k: int = 20,
    every: int = 20,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k rows of largest inner product, found through a k-means tree.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    those with the query's id. The tree is fitted on SAMPLE rows and holds every row.
    True neighbours of CALIBRATION queries over all rows say how many leaves, best bin
    first, hold ``recall`` of them; every query visits as many. Rows in a visited leaf
    are all compared, in double precision on the original vectors.

    Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller
    id. Rows with null ids, vectors that are null, empty, zero or hold a null or
    non-finite component, or of another dimension than most take no part. Rows that
    repeat an id are candidates each, but for queries of that id; as a query the id asks
    once, with the smallest of its vectors. A query whose leaves hold fewer than
    k others visits them all, so fewer candidates than k give all. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    vectors = most_common_dimension(scratch.write(usable_vectors(rows, id_col, vector_col), "vectors"))
    candidates = scratch.write(first_of_alike(vectors, k), "candidates")
    queries = scratch.write(vectors.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")

    def first(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        t = table.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(n).select("id", "v").toArrow()
        return t.column(0).to_numpy(), matrix(t.column(1))

    some = first(queries, CALIBRATION)
    if not len(some[0]):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    longest = float(candidates.agg(F.max(F.sqrt(square))).first()[0])
    tree = Tree.grow(_lifted(first(candidates, SAMPLE)[1], longest))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            if b.num_rows:
                leaf = sent.value.place(_lifted(matrix(b.column(1)), longest))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(leaf)], names=["id", "v", "leaf"])

    placed = scratch.write(candidates.select("id", "v").mapInArrow(place, "id long, v array<double>, leaf long"), "placed")
    truth = exact_neighbours(some, placed, k).select("query_id", F.col("vec_id").alias("id")).distinct()
    truth = placed.join(F.broadcast(truth), "id").select("query_id", "leaf").collect()  # CALIBRATION * k rows
    visits = calibrated_visits(tree, some, longest, [tuple(r) for r in truth], recall)

    held = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = spark.sparkContext.broadcast(held)

    def plan(batches):
        t, n = sent.value, sizes.value
        for b in batches:
            if not b.num_rows:
                continue
            at, leaf = [], []
            for i, q in enumerate(_raised(matrix(b.column(1)), longest)):
                found = t.visit(q, visits)
                if sum(n.get(x, 0) for x in found) <= k:
                    found = t.visit(q, t.leaves)
                found = [x for x in found if x in n]
                at += [i] * len(found)
                leaf += found
            took = pa.array(at, pa.int32())
            yield pa.record_batch([b.column(0).take(took), b.column(1).take(took), pa.array(leaf, pa.int64())], names=["id", "v", "leaf"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-queries.count() // QUERIES))
    asked = scratch.write(queries.select("id", "v").repartition(tasks, "id").mapInArrow(plan, "id long, v array<double>, leaf long"), "asked")
    askers = {r.leaf: r.n for r in asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(x, -(-n // PART), -(-askers.get(x, 0) // QUERIES)) for x, n in held.items()]
    shape = F.broadcast(spark.createDataFrame(shape, "leaf long, parts long, blocks long").filter("blocks > 0"))
    left = asked.join(shape, "leaf").select(
        "id", "v", "leaf", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")
    )
    right = placed.join(shape, "leaf").select(
        "id", "v", "leaf", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("id"), "parts").alias("part")
    )

    def meet(asking: pa.Table, found: pa.Table) -> pa.Table:
        if not asking.num_rows or not found.num_rows:
            return _top((np.empty(0, np.int64), np.empty((0, 0))), np.empty(0, np.int64), np.empty((0, 0)), k)
        return _top((asking["id"].to_numpy(), matrix(asking["v"])), found["id"].to_numpy(), matrix(found["v"]), k)

    cell = ["leaf", "part", "block"]
    return _ranked(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, _HITS), k)
