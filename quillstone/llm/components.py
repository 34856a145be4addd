"""Connected components, and links among rows that share index keys, without pairs of whole groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import Scratch

#: Rows of a key up to which all its pairs may be written out.
LARGE = 256
#: Rows of a hub whose sets make its reference; any reference finds all pairs.
SAMPLED = 15
#: Edges (16 bytes each) up to which the driver finds the components by itself.
FEW = 500_000


def least_reached(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place reaches by ``label`` and the links of ``a`` and ``b``."""
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        new = new[label]
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``comp`` (the smallest node reachable) of every node in ``edges(a, b)``.

    Alternating large-star and small-star steps (Kiveris et al. 2014) over written
    edge tables. Every step is a minimum per node and a join with it, so that a node
    with a third of all edges is pre-aggregated and its join can be split. FEW edges
    are not worth the steps.
    """
    at = 0
    e = scratch.write(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    if all(f.dataType == LongType() for f in e.schema) and e.count() <= FEW:
        return e.sparkSession.createDataFrame(_components(e.toArrow()))
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        at += 1
        e = scratch.write(small.select("e.u", "e.v").filter("u <> v").distinct(), f"{name}-{at}")
        scratch.drop(f"{name}-{at - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v")).distinct())


def _components(edges: pa.Table) -> pa.Table:
    ends = np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()])
    nodes, place = np.unique(ends, return_inverse=True)
    label = least_reached(np.arange(len(nodes)), *place.reshape(2, -1))
    return pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array(nodes[label], pa.int64())})


def _stars(e: DataFrame) -> bool:
    """Whether each node has one parent at most and no parent has a parent."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select(F.col("v"), F.lit(0), F.lit(1))
    )
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
    return bad.isEmpty()


def link_by_keys(
    parts: list[DataFrame],
    nodes: DataFrame,
    near: Callable[[str, str], Column],
    prepare: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    beyond: Callable[[DataFrame, DataFrame], DataFrame],
    scratch: Scratch,
    name: str,
) -> DataFrame:
    """Components under all verified links between rows of ``parts``, tables of
    ``key, node``, that share a key.

    A node has each of its keys once, and no key is in two parts; they are counted one
    after the other, so that only one lies in shuffle files. ``near(a, b)`` is a cheap
    necessary condition on the columns of two aliases of ``nodes(node, ...)``, ``prepare(nodes)``
    gives the contents of nodes, and ``verify(pairs(a, b), contents)`` returns those pairs
    that are links.

    First each row of a key is paired with one hub only, the row that shares the most
    keys with others; that links most of a group of copies by a number of pairs linear
    in it. Keys in which rows are still apart then go to ``beyond(rows, contents)``, which
    gives the candidate pairs that are left.
    """
    others = [c for c in nodes.columns if c != "node"]
    shared = None
    for i, part in enumerate(parts):
        sizes = part.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        some = scratch.write(part.join(sizes.hint("shuffle_hash"), "key"), f"{name}-shared-{i}", free=True)
        shared = shared.union(some) if i else some
    contents = scratch.write(prepare(shared.select("node").distinct()), f"{name}-contents", free=True)
    degree = shared.groupBy("node").agg(F.sum("m").alias("degree")).join(nodes, "node")
    rows = scratch.write(shared.join(degree, "node"), f"{name}-rows", free=True)
    scratch.drop(*[f"{name}-shared-{i}" for i in range(len(parts))])

    rows = rows.withColumn("comp", F.col("node"))
    body = ["node", "comp", *others]
    hubs = rows.groupBy("key").agg(F.max(F.struct("degree", *body)).alias("x"))
    stars = rows.join(hubs, "key").select("x", F.struct(*body).alias("y")).filter((F.col("x.comp") != F.col("y.comp")) & near("x", "y"))
    tested = scratch.write(stars.select(*_pair()).distinct(), f"{name}-pairs-0")
    links = scratch.write(verify(tested, contents), f"{name}-links-0", free=True)
    comp = scratch.write(components(links, scratch, f"{name}-c-0"), f"{name}-comp-0")

    rows = rows.join(hubs.select("key", F.col("x.node").alias("hub")), "key")
    hub_comp = comp.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    rows = rows.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = rows.join(hub_comp, "hub", "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))
    apart = rows.filter("comp <> hub_comp").select("key").distinct()
    rows = scratch.write(rows.join(apart, "key", "left_semi"), f"{name}-rows-0")
    scratch.drop(f"{name}-rows")
    rows = rows.filter("node <> hub")
    apart = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    rows = scratch.write(rows.join(apart, "key", "left_semi"), f"{name}-open")
    scratch.drop(f"{name}-rows-0")
    pairs = scratch.write(beyond(rows, contents).join(tested, ["a", "b"], "left_anti"), f"{name}-pairs-1")
    if not pairs.isEmpty():
        found = scratch.write(verify(pairs, contents), f"{name}-links-1", free=True)
        if not found.isEmpty():
            comp = scratch.write(components(links.union(found), scratch, f"{name}-c-1"), f"{name}-comp-1")
    scratch.drop(f"{name}-apart", f"{name}-references", f"{name}-differences", f"{name}-open")
    return comp


def _once() -> Column:
    """Rows of different components; of two that are both apart from the hub, one order only."""
    linked = F.col("y.comp") == F.col("y.hub_comp")
    return (F.col("x.comp") != F.col("y.comp")) & (linked | (F.col("x.node") < F.col("y.node")))


def _pair() -> list[Column]:
    return [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]


def by_difference(
    rows: DataFrame,
    near: Callable[[str, str], Column],
    others: list[str],
    refer: Callable[[DataFrame], DataFrame],
    differ: Callable[[DataFrame, DataFrame], DataFrame],
    scratch: Scratch,
    name: str,
) -> DataFrame:
    """Candidate pairs of rows with a common hub, of which one at least is apart from it.

    Take any set R as the hub's reference, let D(x) be the elements in which x and R
    differ and s(x) = |D(x)| - r |x|, where a link of x and y allows them to differ in
    r (|x| + |y|) elements. x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements. So

    - if s(x) + s(y) <= 0 they are linked, whatever they hold. Then both are linked with
      the row of the least s too, and pairs with that row are enough;
    - else linked rows have (s(x) + s(y)) / 2 elements of D in common. If what x and y hold
      beside R is more than they may differ in, it must have a common element already,
      and they meet by that alone. If not, by the prefix principle they share one among
      the first |D| + 1 less the common number, with the hub's least s for the other's.
      Where they meet first, what is left of both must still hold the common elements
      that the pair needs.

    R holds what most of SAMPLED rows of the hub hold, so that D is what each row has
    changed for itself, and rows rarely meet. ``refer(sample(hub, node))`` gives ``hub, reference``,
    ``differ(pairs(hub, node), references)`` gives ``hub, node, slack, size, own, diff``: s, |D|, how
    many of D are not in R, and D, those first, each in order of the elements, as far as any
    prefix goes. The rows' own columns join the whole differences, which are parted into
    elements only after that.
    """
    apart = F.col("comp") != F.col("hub_comp")
    rows = rows.select("hub", "node", "comp", "hub_comp", *others).dropDuplicates(["hub", "node"])
    rows = scratch.write(rows.join(rows.filter(apart).select("hub").distinct(), "hub", "left_semi"), f"{name}-apart")
    nth = F.row_number().over(Window.partitionBy("hub").orderBy(F.xxhash64("node"), "node"))
    sample = rows.select("hub", "node").withColumn("nth", nth).filter(F.col("nth") <= SAMPLED).drop("nth")
    references = scratch.write(refer(sample), f"{name}-references")
    found = scratch.write(differ(rows.select("hub", "node"), references).join(rows, ["hub", "node"]), f"{name}-differences", free=True)
    best = found.groupBy("hub").agg(F.min(F.struct("slack", "node", "comp")).alias("best"))
    found = found.join(best, "hub")
    room = F.col("slack") + F.col("best.slack")
    star = found.filter((room <= 1e-6) & (F.col("comp") != F.col("best.comp")))
    star = star.select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b"))

    def meeting(many: Column, column: str, more: Column) -> DataFrame:
        """Pairs by the first elements of D, of which the pair needs as many as ``column`` counts
        beyond half of what a link allows."""
        at = found.select("*", F.posexplode(F.slice("diff", F.lit(1), many.cast("int"))).alias("place", "e"))
        row = F.struct("node", "comp", "hub_comp", "own", "size", (F.col("size") - F.col("slack")).alias("allow"), (F.col(column) - F.col("place")).alias("rest"), *others)
        met = at.filter(apart).select("hub", "e", row.alias("x")).join(at.select("hub", "e", row.alias("y")), ["hub", "e"])
        return met.filter(_once() & more & (F.least("x.rest", "y.rest") >= beyond(column)) & near("x", "y")).select(*_pair())

    def beyond(column: str) -> Column:
        return (F.col(f"x.{column}") + F.col(f"y.{column}") - F.col("x.allow") - F.col("y.allow")) / 2 - 1e-6

    by_own = meeting(F.col("own"), "own", beyond("own") > 0)
    by_all = meeting(F.col("size") + 1 - F.greatest(F.lit(1), F.ceil(room / 2 - 1e-6)), "size", beyond("own") <= 0)
    return star.union(by_own).union(by_all).distinct()
