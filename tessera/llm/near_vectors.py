"""Operator 1, embedding near-dedup: a random-projection tree forest.

Equal vectors of a label are one class.  Each of ``TREES`` trees splits the classes of a
label again and again: a random direction (one a tree and depth), a cut where the
projections are sparsest between their 25 % and 75 % quantiles, and spill: what lies
within ``MARGIN`` of the cut goes to both sides.  A node with at most ``LEAF`` classes is
a leaf, and so is one whose projections spread so little that its vectors are close to
each other (splitting would part a crowd of near copies).  A label that some tree leaves
whole is compared there alone.

Splitting carries ids and projections only, ``PLANES`` depths from one matrix product;
vectors are fetched once, when the leaves are known.  Leaves are compared exactly, a crowd in
blocks: one task per pair of blocks.  A pair counts in the first leaf that its ends share (each
row brings the list of its leaves), so the tasks send a number of links per class and the
edges of a spanning forest, never all pairs; the forests of all trees are united and
components come from distributed rounds.

The method is approximate: a link is lost if every tree parts its ends.  Found links are
exact (cosine in double precision).  tests/llm measure the recall against brute force.

Cases: a vector that is null, zero, or holds null or non-finite components, or whose label
is null, links with nothing and is its own component; a row with a null vec_id links as any
other, its id never names a component (null if no member has one, kept false); vectors of
unlike length never link; vectors of any length are read whole; a pair exactly at the
threshold links; repeated rows link as any other equal vectors, each row counts, also those
of one vec_id; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ROWS_PER_SLICE, connected_components, materialize

THRESHOLD = 0.93
TREES = 6
LEAF = 512
BLOCK = 1024
#: depths whose projections are computed together
PLANES = 8
#: of the typical projected distance of a pair at the threshold, on each side of a cut
MARGIN = 0.5
#: a node is a crowd if d times its projections' variance is below this (1: all directions alike)
CROWD = 0.25
SEED = 11
KEY = ["tree", "label", "dim", "node"]


def _direction(tree: int, depth: int, dim: int) -> np.ndarray:
    g = np.random.default_rng((SEED, tree, depth, dim)).standard_normal(dim)
    return g / np.linalg.norm(g)


def _valid(v):
    return F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a power of two first, so that no square leaves the range of doubles."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projected(classes: DataFrame, trees: int, first: int) -> DataFrame:
    """(tree, label, dim, id, p): each class along the ``PLANES`` directions of each tree from depth ``first`` on."""
    names = [T.StructField("tree", T.IntegerType()), classes.schema["label"], T.StructField("dim", T.IntegerType()),
             T.StructField("id", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = batch.slice(at, ROWS_PER_SLICE)
                v = part.column("v")
                flat, dims = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
                starts = np.cumsum(dims) - dims
                for dim in np.unique(dims).tolist():
                    if dim not in planes:
                        planes[dim] = np.stack([_direction(t, first + k, dim) for t in range(trees) for k in range(PLANES)])
                    rows = np.nonzero(dims == dim)[0]
                    x = flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
                    p = (_unit(x) @ planes[dim].T).ravel()
                    many = pa.array(np.repeat(rows, trees))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(trees, dtype=np.int32), len(rows))), part.column("label").take(many),
                        pa.array(np.full(len(many), dim, np.int32)), part.column("id").take(many),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) + 1, PLANES, dtype=np.int32)), pa.array(p))],
                        names=["tree", "label", "dim", "id", "p"])

    return classes.select("id", "label", "v").mapInArrow(run, T.StructType(names))


def leaves(classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(tree, label, dim, node, id, members): the leaves of all trees; spilled classes are in several."""
    quantiles = [0.25 + 0.05 * i for i in range(11)]
    margin = F.lit(MARGIN * (2 * (1 - threshold)) ** 0.5) / F.sqrt("dim")
    found, nodes, depth = None, None, 0
    while True:
        if depth % PLANES == 0:
            fresh = _projected(classes, trees, depth)
            nodes = fresh.withColumn("node", F.lit("r")) if nodes is None else nodes.drop("p").join(fresh.select("tree", "id", "p"), ["tree", "id"])
            nodes = materialize(nodes, "projected")
        at = F.col("p")[depth % PLANES]
        measured = nodes.groupBy(*KEY).agg(F.count("*").alias("members"), F.var_pop(at).alias("var"), F.percentile_approx(at, quantiles, 2000).alias("q"))
        gaps = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct((F.element_at("q", i + 1) - F.element_at("q", i)).alias("gap"),
                                                                               ((F.element_at("q", i + 1) + F.element_at("q", i)) / 2).alias("cut")))
        cuts = measured.select(*KEY, "members", F.array_max(gaps)["cut"].alias("cut"),
                               ((F.col("members") <= leaf) | (F.col("var") * F.col("dim") < CROWD)).alias("final"))
        if depth == 0:  # one row a tree and label: a label that a tree leaves whole needs no other tree
            whole = cuts.where("final").groupBy("label", "dim").agg(F.min("tree").alias("whole"))
            cuts = cuts.join(whole, ["label", "dim"], "left").where("whole is null or whole = tree").drop("whole")
        sides = F.when(F.col("final"), F.array(F.lit(""))).otherwise(F.array_compact(F.array(
            F.when(at < F.col("cut") + margin, F.lit("l")), F.when(at >= F.col("cut") - margin, F.lit("r")))))
        split = nodes.join(cuts, KEY).withColumn("side", F.explode(sides))
        split = materialize(split.select("tree", "label", "dim", F.concat("node", "side").alias("node"), "id", "members", "final", "p"), "nodes")
        done = split.where("final").select(*KEY, "id", "members")
        found = done if found is None else found.unionByName(done)
        nodes = split.where("not final").drop("members", "final")
        if nodes.isEmpty():
            return found
        depth += 1


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row of a symmetric matrix."""
    n = len(linked)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(linked, low, n).min(1))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def leaf_links(classes: DataFrame, found: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, links, root) per class with links that count in a pair of blocks: the rows it is linked
    with there, and a class that they connect it with."""
    at = F.collect_list(F.struct("tree", "node", "members", F.xxhash64(*KEY).alias("leaf")))
    t = classes.join(found.groupBy("id").agg(at.alias("at")), "id").withColumn("dim", F.size("v"))
    t = t.select("id", "label", "dim", "v", "copies", F.col("at.leaf").alias("leaves"), F.explode("at").alias("in")).select("*", "in.*").drop("in")
    t = t.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    t = t.select(*KEY, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v", "copies", "leaf", "leaves")

    def links(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n, this = group.num_rows, group["leaf"][0].as_py()
        flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = _unit(flat(group["v"]).reshape(n, -1).astype(np.float64))
        ids, copies, own = (group[c].to_numpy() for c in ("id", "copies", "own"))
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if group["x"][0].as_py() != group["y"][0].as_py():
            linked &= own[:, None] != own
        some = np.nonzero(linked.any(1))[0]
        linked = linked[np.ix_(some, some)]
        # a pair counts in the smallest leaf that both ends are in
        lists = group["leaves"].combine_chunks().take(pa.array(some))
        owner, leaf = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
        before = leaf < this
        names, column = np.unique(leaf[before], return_inverse=True)
        member = np.zeros((len(some), len(names)), np.float32)
        member[owner[before], column] = 1
        linked &= member @ member.T == 0
        linked &= linked.T
        some, keep = some[linked.any(1)], linked.any(1)
        linked = linked[np.ix_(keep, keep)]
        count = (linked @ copies[some].astype(np.float64)).astype(np.int64)
        return pa.table({"id": ids[some], "links": count, "root": ids[some][_components(linked)] if len(some) else ids[some]})

    return t.groupBy(*KEY, "x", "y").applyInArrow(links, "id long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: x + F.lit(0).cast("float")).alias("v"))
    v = v.withColumn("valid", _valid(F.col("v")))
    v = v.withColumn("v", F.when(F.col("valid"), F.col("v")))  # -0.0 has become 0.0
    # a class is named by a hash of its label and vector, a repeated vec_id may be in several
    numbered = v.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    numbered = materialize(numbered.withColumn("id", F.xxhash64("label", "v")), "vector-classes")
    classes = numbered.select("id", "label", "v", "copies")
    links = materialize(leaf_links(classes, leaves(classes, threshold, trees, leaf), threshold, block), "vector-links")
    others = links.groupBy("id").agg(F.sum("links").alias("others"))
    component = connected_components(links, "id", "root").withColumnsRenamed({"node": "id", "component": "root"})
    members = numbered.select("id", "rep", "copies").join(others, "id", "left").join(component, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    summary = members.join(named, "root").select("id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = v.withColumn("id", F.when(F.col("valid"), F.xxhash64("label", "v"))).select("vec_id", "id").join(summary, "id", "left")
    component_id = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))
