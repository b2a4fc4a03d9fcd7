"""Condensed hierarchy of a maximum spanning forest, over every merge.

Falling similarity joins components.  A component of at least ``min_size`` rows is a cluster; it goes on while smaller ones join it and
ends, as the child of a new one, where it meets another cluster.  Its stability is the sum over its rows of the density at
which each joined it, less the density at which it ends; density is 1 / (1 - similarity), with similarities above
0.999 counting as 0.999.  Merges of one similarity happen at once, so the hierarchy depends on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import doubles, ints
from reelspark.llm.forest import boruvka
from reelspark.operators.ordering import spread
from reelspark.session import cut_lineage

LOCAL_NODES = 1_000_000  # components of so many vectors are condensed in one task (about 600 MB); larger ones in pieces
CUTS = (0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995, 0.999)  # similarities at which larger ones are tried to be cut


def density(w: float) -> float:
    return 1 / max(1 - w, 0.001)


class Condensed:
    """Clusters of a forest over ``size`` rows a node.

    ``held`` and ``inside`` describe nodes that are pieces condensed before: their rows' densities summed up, and the best
    stability of what is in them.  After ``run``: ``leaf`` and ``joined`` of each node (cluster it joined, density then), and of
    each cluster ``stability`` and ``owner`` (the selected cluster it belongs to, or -1).
    """

    def __init__(self, size, min_size: int, held=None, inside=None):
        n = len(size)
        self.min_size, self.total = min_size, list(size)
        self.parent, self.live = list(range(n)), [-1] * n
        self.loose: list = [[i] for i in range(n)]
        self.leaf, self.joined = [-1] * n, [density(1.0)] * n
        self.sum, self.n, self.kids, self.end, self.below = [], [], [], [], []
        for i in range(n):
            if self.total[i] >= min_size:
                c = self._new(self.total[i] * density(1.0) if held is None else held[i], [], 0.0 if inside is None else inside[i])
                self.live[i] = self.leaf[i] = c
                self.n[c] = self.total[i]
                self.loose[i] = []

    def _new(self, total: float, kids: list, below: float = 0.0) -> int:
        self.sum.append(total)
        self.n.append(0)
        self.kids.append(kids)
        self.end.append(None)
        self.below.append(below)
        return len(self.sum) - 1

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def _merge(self, roots: list, d: float) -> None:
        root = max(roots, key=lambda r: (self.total[r], -r))
        big = [r for r in roots if self.live[r] >= 0]
        n = sum(self.total[r] for r in roots)
        if not big:
            c = self._new(n * d, []) if n >= self.min_size else -1
        elif len(big) == 1:
            c = self.live[big[0]]
            self.sum[c] += (n - self.total[big[0]]) * d
        else:
            for r in big:
                self.end[self.live[r]] = d
            c = self._new(n * d, [self.live[r] for r in big])
        for r in roots:
            self.parent[r] = root
            if c >= 0:
                for i in self.loose[r]:
                    self.leaf[i], self.joined[i] = c, d
                self.loose[r] = []
            elif r != root:
                self.loose[root] += self.loose[r]
                self.loose[r] = []
        self.total[root], self.live[root] = n, c
        if c >= 0:
            self.n[c] = n

    def run(self, u, v, w, least: float, pick: bool = True):
        """Joins along the edges; with ``pick`` clusters end at ``least`` and the most stable ones are selected."""
        import numpy as np

        order = np.argsort(-np.asarray(w), kind="stable")
        a, b, w = np.asarray(u)[order].tolist(), np.asarray(v)[order].tolist(), np.asarray(w)[order].tolist()
        i, m = 0, len(w)
        while i < m:
            j = i + 1
            while j < m and w[j] == w[i]:
                j += 1
            if j == i + 1:
                ra, rb = self.find(a[i]), self.find(b[i])
                if ra != rb:
                    self._merge([ra, rb], density(w[i]))
            else:
                meet: dict[int, int] = {}

                def top(r):
                    while meet.setdefault(r, r) != r:
                        r = meet[r]
                    return r

                for k in range(i, j):
                    x, y = top(self.find(a[k])), top(self.find(b[k]))
                    meet[max(x, y)] = min(x, y)
                sets: dict[int, list] = {}
                for r in sorted(meet):
                    sets.setdefault(top(r), []).append(r)
                for roots in sets.values():
                    if len(roots) > 1:
                        self._merge(roots, density(w[i]))
            i = j
        floor = density(least)
        self.stability = [s - n * (floor if e is None else e) for s, n, e in zip(self.sum, self.n, self.end)]
        self.best, stands, self.up = [], [], [-1] * len(self.sum)
        for c, kids in enumerate(self.kids):
            inner = self.below[c] + sum(self.best[k] for k in kids)
            for k in kids:
                self.up[k] = c
            stands.append(self.stability[c] >= inner)
            self.best.append(max(self.stability[c], inner))
        self.owner = [-1] * len(self.sum)
        for c in range(len(self.sum) - 1, -1, -1):
            above = self.owner[self.up[c]] if self.up[c] >= 0 else -1
            self.owner[c] = above if above >= 0 else c if pick and stands[c] else -1
        return self


def _sets(batches, width: int):
    """Complete sets (of one key, the first column) of a sorted stream, many small ones at a time."""
    import numpy as np

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([doubles(batch.column(i)) if batch.schema.field(i).name in ("w", "held", "inside") else ints(batch.column(i), -1) for i in range(width)])
        rows += batch.num_rows
        if rows < 200_000:
            continue
        whole = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in whole]
        held, rows = [[c[cut:] for c in whole]], rows - cut
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _local(edges: DataFrame, nodes: DataFrame, least: float, min_size: int, pieces: bool) -> DataFrame:
    """Per set (column ``comp``) of edges (u, v, w) and nodes (node, size, held, inside): rows of nodes and, of ``pieces``, of sets.

    kind 0: node a, selected cluster b within the set (or -1), its stability x, density y at which the node joined, size c.
    kind 1 (a piece that holds a cluster): size c, densities summed up x, best stability y of what is in its outermost cluster.
    """
    null = lambda t: F.lit(None).cast(t)
    rows = edges.select("comp", F.lit(0).alias("kind"), "u", "v", null("bigint").alias("size"), "w", null("double").alias("held"), null("double").alias("inside"))
    rows = rows.unionByName(
        nodes.select("comp", F.lit(1).alias("kind"), F.col("node").alias("u"), null("bigint").alias("v"), "size", null("double").alias("w"), "held", "inside")
    )
    rows = spread(rows, "comp").sortWithinPartitions("comp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for comp, kind, u, v, size, w, held, inside in _sets(batches, 8):
            is_node = kind == 1
            ids, at = np.unique(u[is_node], return_index=True)
            own = lambda c: c[is_node][at]
            edge = ~is_node
            known = ~np.isnan(own(held))
            c = Condensed(own(size).tolist(), min_size, *((own(held).tolist(), own(inside).tolist()) if known.any() else ()))
            c.run(np.searchsorted(ids, u[edge]), np.searchsorted(ids, v[edge]), w[edge], least, True)
            comps = own(comp)
            leaf, owner = np.array(c.leaf, np.int64), np.array([*c.owner, -1])
            stab = np.array([*c.stability, np.nan])
            if pieces:
                # the outermost cluster goes on above this piece: what is chosen in it is chosen without it
                outer = np.array([e is None for e in c.end] + [False])
                pick = [-1] * len(c.sum)
                for k in range(len(c.sum) - 1, -1, -1):
                    above = pick[c.up[k]] if c.up[k] >= 0 else -1
                    pick[k] = above if above >= 0 else k if not outer[k] and c.stability[k] >= c.below[k] + sum(c.best[j] for j in c.kids[k]) else -1
                owner = np.array([*pick, -1])
                roots = np.flatnonzero(outer)
                home = np.full(len(c.sum) + 1, -1)
                for i in range(len(ids)):
                    k = c.live[c.find(i)]
                    if k >= 0:
                        home[k] = comps[i]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(home[roots]), pa.array(np.ones(len(roots), np.int32)), pa.array(np.zeros(len(roots), np.int64)), pa.array(np.zeros(len(roots), np.int64)),
                        pa.array(np.array(c.n, np.int64)[roots]), pa.array(np.array(c.sum)[roots]), pa.array(np.array([c.below[k] + sum(c.best[j] for j in c.kids[k]) for k in roots], float)),
                    ],
                    ["comp", "kind", "a", "b", "c", "x", "y"],
                )
            mine = owner[leaf]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(comps), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(mine), pa.array(own(size)),
                    pa.array(np.where(mine >= 0, stab[mine], np.nan)), pa.array(np.array(c.joined)),
                ],
                ["comp", "kind", "a", "b", "c", "x", "y"],
            )

    return rows.mapInArrow(run, "comp bigint, kind int, a bigint, b bigint, c bigint, x double, y double")


def condensed(tree: DataFrame, nodes: DataFrame, least: float, min_size: int, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(node, root, tier, cluster, stability, joined) of every node of a component of at least ``min_size`` rows.

    tree: forest edges (u, v, w); nodes: (node, comp, size), size being the rows a node stands for.  root is the component: the
    hierarchy's outermost cluster.  (root, tier, cluster) names the selected cluster, cluster is -1 where a node is in none.

    A component of at most ``local_nodes`` nodes is condensed in one task.  A larger one is cut at the least of ``CUTS`` at which
    all pieces are that small; pieces are condensed apart, then a hierarchy whose nodes are the pieces goes on above the cut.
    The result is the same.  Components that no cut makes small raise an error.
    """
    sizes = nodes.groupBy("comp").agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("nodes")).where(F.col("rows") >= min_size)
    sizes = cut_lineage(sizes)
    none = F.lit(None).cast("double")
    inner = nodes.join(sizes.where(F.col("nodes") <= local_nodes).select("comp"), "comp").select("comp", "node", "size", none.alias("held"), none.alias("inside"))
    at = nodes.select(F.col("node").alias("u"), "comp")
    edges = tree.join(at, "u").select("comp", "u", "v", "w")
    small = edges.join(sizes.where(F.col("nodes") <= local_nodes).select("comp"), "comp")
    shape = [F.col("a").alias("node"), F.col("comp").alias("root"), F.lit(0).alias("tier"), F.col("b").alias("cluster"), F.col("x").alias("stability"), F.col("y").alias("joined")]
    out = _local(small, inner, least, min_size, False).select(*shape)
    giants = sizes.where(F.col("nodes") > local_nodes)
    if giants.isEmpty():
        return out
    wide = cut_lineage(nodes.join(giants.select("comp"), "comp"))
    links = cut_lineage(edges.join(giants.select("comp"), "comp"))
    for cut in CUTS:
        _, label = boruvka(links.where(F.col("w") >= cut).select("u", "v", "w"))
        piece = wide.join(label.withColumnRenamed("comp", "piece"), "node", "left").withColumn("piece", F.coalesce("piece", "node"))
        piece = cut_lineage(piece)
        if piece.groupBy("piece").count().where(F.col("count") > local_nodes).isEmpty():
            break
    else:
        raise RuntimeError("a component of near-equal vectors is too large to be condensed")
    home = piece.select(F.col("node").alias("u"), "piece")
    within = links.where(F.col("w") >= cut).join(home, "u").select(F.col("piece").alias("comp"), "u", "v", "w")
    parts = cut_lineage(_local(within, piece.select(F.col("piece").alias("comp"), "node", "size", none.alias("held"), none.alias("inside")), cut, min_size, True))
    # above the cut: pieces that hold a cluster are one node each, the nodes of smaller ones stay together
    held = parts.where("kind = 1").select(F.col("comp").alias("piece"), F.col("x").alias("held"), F.col("y").alias("inside"))
    whole = piece.groupBy("comp", "piece").agg(F.sum("size").alias("size")).join(held, "piece", "left")
    over = whole.select("comp", F.col("piece").alias("node"), "size", F.coalesce("held", F.lit(0.0)).alias("held"), F.coalesce("inside", F.lit(0.0)).alias("inside"))
    across = links.where(F.col("w") < cut).join(home, "u").select("comp", F.col("piece").alias("pu"), "v", "w")
    across = across.join(home.select(F.col("u").alias("v"), F.col("piece").alias("pv")), "v").select("comp", F.col("pu").alias("u"), F.col("pv").alias("v"), "w")
    top = cut_lineage(_local(across, over, least, min_size, False))
    above = top.select(F.col("a").alias("piece"), F.col("comp").alias("root"), F.col("b").alias("tb"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    rows = parts.where("kind = 0").select(F.col("comp").alias("piece"), F.col("a").alias("node"), "b", "x", "y").join(above, "piece").join(held.select("piece", F.lit(True).alias("big")), "piece", "left")
    upper = F.col("tb") >= 0
    low = rows.select(
        "node", "root", F.when(upper, 1).otherwise(2).alias("tier"),
        # clusters of different pieces keep apart by the piece, which is part of the name
        F.when(upper, F.col("tb")).when(F.col("b") >= 0, F.xxhash64("piece", "b").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(F.lit(-1)).alias("cluster"),
        F.when(upper, F.col("tx")).otherwise(F.col("x")).alias("stability"), F.when(F.col("big"), F.col("y")).otherwise(F.col("ty")).alias("joined"),
    )
    return out.unionByName(low)
