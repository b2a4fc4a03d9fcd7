"""Maximum spanning forests: within a block of vectors (NumPy) and over a distributed edge table (Borůvka).

The forest of a graph is contained in the union of the forests of its parts: an edge that a part leaves out closes a cycle of edges
of that part that weigh no less, and these stay.  Parts may therefore be reduced on their own, with ties broken in any way: the
components at every weight are those of the whole graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import doubles, ints
from reelspark.session import cut_lineage

FINISH_EDGES = 2_000_000  # so many edges are reduced in one task (about 300 MB); above, distributed rounds come first


def reduce_edges(u, v, w, n: int):
    """(indices of the edges that form the maximum spanning forest, component label) of positions u, v below ``n``.

    A component's label is its smallest position.  Equal weights go by position.
    """
    import numpy as np

    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), -w))
    a, b, e = u[order], v[order], order
    label = np.arange(n)
    out = []
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, e, la, lb = a[open_], b[open_], e[open_], la[open_], lb[open_]
        if not len(a):
            break
        # every component's first edge in the order: written from the last edge to the first, so the first stays
        best = np.full(n, len(a))
        at = np.arange(len(a))[::-1]
        best[la[::-1]] = at
        other_best = np.full(n, len(a))
        other_best[lb[::-1]] = at
        best = np.minimum(best, other_best)
        comp = np.flatnonzero(best < len(a))
        pick = best[comp]
        out.append(np.unique(e[pick]))
        parent = np.arange(n)
        parent[comp] = np.where(la[pick] == comp, lb[pick], la[pick])
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    first = np.full(n, n)
    np.minimum.at(first, label, np.arange(n))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), first[label]


def block_forest(x, ids, core, least: float, block: int = 2048):
    """Forest edges (id, id, weight) among the rows of x (int16); weight: min of cosine and both core similarities.

    Single precision picks the pairs, their weights come from the exact integers.  Memory stays at a few blocks squared
    however many rows there are.
    """
    import numpy as np

    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    unit = (x / norm[:, None]).astype(np.float32)
    n = len(x)
    hu, hv, hw = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    fits = None if core is None else core >= least
    for a in range(0, n, block):
        for b in range(a, n, block):
            s = unit[a : a + block] @ unit[b : b + block].T
            flat = np.flatnonzero(s >= least - 1e-5)
            i, j = flat // s.shape[1] + a, flat % s.shape[1] + b
            k = i < j
            if fits is not None:
                k &= fits[i] & fits[j]
            i, j = i[k], j[k]
            w = exact_cosines(x, norm, x, norm, i, j)
            if core is not None:
                w = np.minimum(np.minimum(w, core[i]), core[j])
            k = w >= least
            hu, hv, hw = np.r_[hu, i[k]], np.r_[hv, j[k]], np.r_[hw, w[k]]
            if len(hu) > 4 * n or b + block >= n:
                keep, _ = reduce_edges(hu, hv, hw, n)
                hu, hv, hw = hu[keep], hv[keep], hw[keep]
    return ids[hu], ids[hv], hw


def exact_cosines(x, xn, y, yn, i, j):
    """Cosines of x[i] and y[j] from integer rows: the sums are exact, so a pair has the same value wherever it is met."""
    import numpy as np

    out = np.empty(len(i))
    for s in range(0, len(i), 32768):
        p, q = i[s : s + 32768], j[s : s + 32768]
        out[s : s + 32768] = np.einsum("ij,ij->i", x[p].astype(np.float64), y[q].astype(np.float64)) / (xn[p] * yn[q])
    return np.minimum(out, 1.0)


def finish(edges: DataFrame) -> DataFrame:
    """(kind, x, y, w) of a bounded edge table (a, b, w, u, v): forest edges (0, u, v, w) and labels (1, node, component, -)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [[ints(b.column(0)), ints(b.column(1)), doubles(b.column(2)), ints(b.column(3)), ints(b.column(4))] for b in batches if b.num_rows]
        if not held:
            return
        a, b, w, u, v = (np.concatenate(c) for c in zip(*held))
        del held
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keep, label = reduce_edges(at[: len(a)], at[len(a) :], w, len(nodes))
        names = ["kind", "x", "y", "w"]
        for kind, x, y, z in ((0, u[keep], v[keep], w[keep]), (1, nodes, nodes[label], np.zeros(len(nodes)))):
            for s in range(0, len(x), 65536):
                e = slice(s, s + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[e]), kind, np.int32)), pa.array(x[e]), pa.array(y[e]), pa.array(z[e])], names)

    return edges.select("a", "b", "w", "u", "v").repartition(1).mapInArrow(run, "kind int, x bigint, y bigint, w double")


def boruvka(edges: DataFrame, finish_edges: int = FINISH_EDGES, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Maximum spanning forest (u, v, w) and components (node, comp) of an edge table (u, v, w) with u < v.

    comp is a node of the component.  A round picks every component's best edge and merges along it; chains are shortened by
    pointer doubling, and what a round leaves unmerged keeps its edges and is merged later (every set's best outgoing edge
    belongs to the forest, so picking one twice does no harm).  Edges inside a component fall out, so at most one round
    in two halves the components; what is left of them then is reduced in one task.  State is written between rounds;
    the driver gets counts.
    """
    work = edges.groupBy("u", "v").agg(F.max("w").alias("w"))
    work = cut_lineage(work.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"))
    forest: list[DataFrame] = []
    steps: list[DataFrame] = []
    nodes = None
    for _ in range(max_rounds):
        if work.count() <= finish_edges:
            break
        if nodes is None:
            nodes = cut_lineage(work.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        key = F.struct("w", (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv"))
        ends = work.select(F.col("a").alias("c"), F.col("b").alias("to"), key.alias("k")).unionByName(
            work.select(F.col("b").alias("c"), F.col("a").alias("to"), key.alias("k"))
        )
        best = cut_lineage(ends.groupBy("c").agg(F.max("k").alias("k"), F.max_by("to", "k").alias("to")))
        forest.append(best.select((-F.col("k.nu")).alias("u"), (-F.col("k.nv")).alias("v"), F.col("k.w").alias("w")))
        back = best.select(F.col("c").alias("to"), F.col("to").alias("again"))
        up = best.join(back, "to").select(
            "c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")
        )
        for _ in range(2):
            far = up.select(F.col("c").alias("p"), F.col("p").alias("q"))
            up = up.join(far, "p").select("c", F.col("q").alias("p"))
        up = cut_lineage(up)
        for end in ("a", "b"):
            moved = up.select(F.col("c").alias(end), F.col("p").alias("to"))
            rest = [c for c in ("a", "b", "w", "u", "v") if c != end]
            work = work.join(moved, end, "left").select(F.coalesce("to", end).alias(end), *rest)
        # of the edges between the same two components only the best can be in the forest
        lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        work = work.where("a <> b").select(lo, hi, F.struct("w", (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv")).alias("k"))
        work = work.groupBy("a", "b").agg(F.max("k").alias("k"))
        work = cut_lineage(work.select("a", "b", F.col("k.w").alias("w"), (-F.col("k.nu")).alias("u"), (-F.col("k.nv")).alias("v")))
        steps.append(up)
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    last = cut_lineage(finish(work))
    tree = last.where("kind = 0").select(F.col("x").alias("u"), F.col("y").alias("v"), "w")
    final = last.where("kind = 1").select(F.col("x").alias("comp"), F.col("y").alias("p"))
    if nodes is None:
        return tree, final.select(F.col("comp").alias("node"), F.col("p").alias("comp"))
    for f in forest:
        tree = tree.unionByName(f)
    label = nodes.withColumn("comp", F.col("node"))
    for up in [*[s.select(F.col("c").alias("comp"), "p") for s in steps], final]:
        label = label.join(up, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
    return tree.distinct(), cut_lineage(label)
