"""Exact top-k by inner product over vectors bucketed by length."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .vectors import best_rows, first_of_alike, matrix, most_common_dimension

#: Vectors in a bucket and queries in a block: what meets in one group.
BUCKET, QUERIES = 4096, 512
#: Above this local cosine threshold coordinates prune, below it length alone does.
STEEP = 0.6
#: Coordinates of largest size that coordinate pruning looks at.
FOCUS = 12


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` with floor(scale * x) of each component, as whole doubles; rows whose vector is
    null or holds a null or non-finite component are left out, as are those without an id."""
    most = sys.float_info.max

    def whole(x):
        y = F.least(F.greatest(x.cast("double") * scale, F.lit(-most)), F.lit(most))
        return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)

    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("v"))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of whole doubles: in floating point where every partial sum
    fits 53 bits, in whole numbers beyond; what 64 bits cannot hold becomes the nearest
    number that they can."""
    q, c = q.astype(float), c.astype(float)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(q).max(), np.abs(c).max()) < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    as_whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c)]
    return np.clip(as_whole[0] @ as_whole[1].T, -(2**63), 2**63 - 1).astype(np.int64)


def _candidates(q: np.ndarray, length: float, floor: float, c: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Rows of a bucket (longest first) that can reach ``floor`` with query ``q``; None: no row can.

    The bucket's local threshold is the cosine that its longest vector would need. If
    it is low, only lengths prune: rows too short for any cosine up to 1. If it is
    high, the query's largest coordinates bound the rest by Cauchy and Schwarz.
    """
    if length == 0 or norms[0] == 0:
        return None if floor > 0 else np.arange(len(c))
    local = floor / (length * norms[0])
    if local > 1 + 1e-9:
        return None
    if local <= 0:
        return np.arange(len(c))
    reach = int(np.searchsorted(-norms, -floor / length * (1 - 1e-9), "right"))
    rows = np.arange(reach)
    if local < STEEP or len(q) <= FOCUS:
        return rows
    focus = np.argpartition(-np.abs(q), FOCUS)[:FOCUS]
    part = c[:reach][:, focus].astype(float)
    rest_q = max(0.0, length**2 - float(np.square(q[focus].astype(float)).sum())) ** 0.5
    rest_c = np.sqrt(np.maximum(0, np.square(norms[:reach]) - np.square(part).sum(axis=1)))
    return rows[part @ q[focus].astype(float) + rest_q * rest_c >= floor * (1 - 1e-9) - 1e-6]


def search_bucket(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int):
    """Each query's k best of one bucket that reach its floor: (query, id, score) arrays."""
    if not len(q_ids) or not len(ids):
        return
    norms = np.sqrt(np.square(c.astype(float)).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    ids, c, norms = ids[order], c[order], norms[order]
    lengths = np.sqrt(np.square(q.astype(float)).sum(axis=1))
    sets = [_candidates(q[i], lengths[i], floors[i], c, norms) for i in range(len(q))]
    live = [i for i, s in enumerate(sets) if s is not None and len(s)]
    wide = [i for i in live if 4 * len(sets[i]) >= len(c)]  # one product for all that keep much of the bucket
    at = {i: n for n, i in enumerate(wide)}
    products = _scores(q[wide], c) if wide else None
    for i in live:
        rows = sets[i]
        s = products[at[i]][rows] if i in at else _scores(q[i : i + 1], c[rows])[0]
        keep = np.flatnonzero((s >= floors[i]) & (ids[rows] != q_ids[i]))
        if len(keep):
            best = keep[best_rows(ids[rows[keep]], s[keep], k)]
            yield q_ids[i], ids[rows[best]], s[best]


def top_k(
    rows: DataFrame,
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k rows of largest integer inner product, exactly.

    Queries are the rows whose id is divisible by ``every``; a query's candidates are
    all rows but those with its id. Rows are range-partitioned by length into buckets
    of about BUCKET; blocks of queries meet the buckets that can still reach the lowest
    of their floors (a floor is a query's k-th score among the BUCKET longest rows).
    In a bucket each query is dropped after one comparison, or prunes by length or by
    coordinates, and what is left is verified by exact products. Scores that 64 bits
    cannot hold become the least or the largest number that they can.

    Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller
    id. Rows with null ids, null or empty vectors, null or non-finite components, or
    another dimension than most rows take no part; a zero vector does (its products
    are 0). Rows that repeat an id are candidates each, but for queries of that id; as a
    query the id asks once, with the smallest of its vectors. Fewer candidates than k give all; an empty
    table gives no rows. Other columns are ignored. The driver holds one number for
    each bucket and each block of queries.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    ints = most_common_dimension(scratch.write(integer_vectors(rows, scale, id_col, vector_col), "integers"))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    candidates = first_of_alike(ints, k).withColumn("length", F.sqrt(square))
    buckets = max(1, -(-ints.count() // BUCKET))
    candidates = scratch.write(
        candidates.repartitionByRange(buckets, F.desc("length"), "id").withColumn("c", F.spark_partition_id().cast("long")), "candidates"
    )
    longest = candidates.select("id", "v", "length").orderBy(F.desc("length"), "id").limit(BUCKET).select("id", "v").toArrow()
    top = spark.sparkContext.broadcast((longest.column(0).to_numpy(), matrix(longest.column(1))))

    queries = ints.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.withColumn("length", F.sqrt(square))

    def first_floor(batches):
        ids, c = top.value
        for b in batches:
            if not b.num_rows:
                continue
            q_ids, q = b.column(0).to_numpy(), matrix(b.column(1))
            floor = np.full(len(q_ids), -(2**63), np.int64)
            for at in range(0, len(q_ids), QUERIES):
                s = _scores(q[at : at + QUERIES], c)
                for i, row in enumerate(s, at):
                    own = row[ids != q_ids[i]]
                    if len(own) >= k:
                        floor[i] = np.partition(own, len(own) - k)[len(own) - k]
            yield pa.record_batch([*(b.column(i) for i in range(3)), pa.array(floor)], names=["id", "v", "length", "floor"])

    floored = queries.select("id", "v", "length").mapInArrow(first_floor, "id long, v array<double>, length double, floor long")
    floored = scratch.write(floored, "queries")
    blocks = max(1, -(-floored.count() // QUERIES))
    floored = floored.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    # buckets by falling length, so that a block needs the first few of them
    reach = {r.c: r.reach for r in candidates.groupBy("c").agg(F.max("length").alias("reach")).collect()}
    need = F.when(F.col("length") == 0, F.when(F.col("floor") > 0, float("inf")).otherwise(0.0)).otherwise(F.col("floor") / F.col("length"))
    needs = {r.g: r.need for r in floored.groupBy("g").agg(F.min(need).alias("need")).collect()}
    order = sorted(reach, key=lambda c: (-reach[c], c))
    lengths = np.array([-reach[c] for c in order])
    wanted = {g: int(np.searchsorted(lengths, -x * (1 - 1e-9), "right")) for g, x in needs.items()}
    by_want = sorted(wanted, key=lambda g: (-wanted[g], g))
    of_block = [(g, i, wanted[g]) for i, g in enumerate(by_want)]
    most = np.sort(np.array([*wanted.values()], np.int64))
    at_place = [(c, i, len(most) - int(np.searchsorted(most, i, "right"))) for i, c in enumerate(order)]
    if not at_place or not of_block:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    c_places = F.broadcast(spark.createDataFrame(at_place, "c long, cell long, blocks long"))
    g_places = F.broadcast(spark.createDataFrame(of_block, "g long, block long, cells long"))
    left = floored.join(g_places, "g").filter("cells > 0").select("id", "v", "floor", "block", F.explode(F.expr("sequence(0L, cells - 1)")).alias("cell"))
    right = candidates.join(c_places, "c").filter("blocks > 0").select("id", "v", "cell", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))

    def meet(queries: pa.Table, found: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        if queries.num_rows and found.num_rows:
            q = (queries["id"].to_numpy(), matrix(queries["v"]), queries["floor"].to_numpy())
            for q_id, ids, s in search_bucket(*q, found["id"].to_numpy(), matrix(found["v"]), k):
                out.append((np.full(len(ids), q_id), ids, s))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    hits = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
