"""Groups of mutually similar records: hierarchical density clustering.

1. Vectors are placed in overlapping cells (``cells``); exact copies travel once.
2. Each cell reduces its mutual-reachability graph to its spanning forest (``forest.block_forest``), large cells through cells of their own.
3. Distributed Borůvka merges the cells' forests; ``links_between`` adds every link that no cell holds, so components are exact.
4. The spanning forest is condensed over all its merges (``condense``): components below ``min_size`` are shed, a cluster goes on while one
   large part remains and ends where it splits; stability picks the clusters; the most persistent members stand for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import binary, doubles, ints, matrix
from reelspark.llm.cells import Cells, bounded_sample, make_cells, vector_length
from reelspark.llm.condense import LOCAL_NODES, condensed
from reelspark.llm.forest import FINISH_EDGES, block_forest, boruvka, exact_cosines
from reelspark.llm.knn import _bytes, planes, to_int16, unplanes
from reelspark.operators.ordering import spread, tasks
from reelspark.session import cut_lineage, drop_table, free_shuffles

WIDE = 0.85  # components whose rows are on average less alike than this are bounded in pieces
MOST_IN_CELL = 8192  # rows of a cell above which it is searched through cells of its own


def compact(df: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """(id, load): usable vectors as 16-bit integers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, ok = matrix(batch.column(1), dim, "float64")
            yield pa.RecordBatch.from_arrays([pa.array(ints(batch.column(0))[ok]), binary(planes(to_int16(x[ok])))], ["id", "load"])

    slim = df.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull())
    slim = slim.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return slim.mapInArrow(run, "id bigint, load binary")


def sets_of(batches, columns):
    """Complete sets of rows of one key (the first column, sorted) of a stream: (key, [arrays])."""
    import numpy as np

    held, now = [], None
    for batch in batches:
        keys = ints(batch.column(0))
        edges = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)] if len(keys) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            if keys[a] != now and held:
                yield now, [np.concatenate(v) for v in zip(*held)]
                held = []
            now = keys[a]
            part = batch.slice(a, b - a)
            held.append([f(part.column(i)) for i, f in columns])
    if held:
        yield now, [np.concatenate(v) for v in zip(*held)]


def subcells(x, per_cell: int, copies: float, most: int):
    """Row sets of a large cell: overlapping cells trained on at most 8192 of its own rows; the whole cell if it is small."""
    import numpy as np

    n = len(x)
    if n <= MOST_IN_CELL:
        return [np.arange(n)]
    unit = x.astype(np.float32)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    cells = make_cells(unit[:: -(-n // 8192)], n, per_cell, copies, most)
    r, c = cells.place(unit)
    order = np.argsort(c, kind="stable")
    return np.split(r[order], np.flatnonzero(np.diff(c[order])) + 1)


def cells_of(rows: DataFrame, dim: int, per_cell: int, copies: float, most_cells: int) -> Cells:
    """Cells from a bounded sample of rows (id, load)."""
    import numpy as np

    n = rows.count()
    whole = rows.mapInArrow(_vectors(dim), "id bigint, v array<double>")
    sample = bounded_sample(whole, "id", "v", n, dim)
    norm = sample / np.maximum(np.sqrt((sample**2).sum(1)), 1e-300)[:, None] if len(sample) else np.ones((1, dim)) / np.sqrt(dim)
    return make_cells(norm, n, per_cell, copies, most_cells)


def graph(
    distinct: DataFrame, cells: Cells, least: float, min_samples: int, dim: int, per_cell: int, copies: float, most_cells: int
) -> tuple[DataFrame, DataFrame]:
    """Forest edges (u, v, w) of all cells, and (rep, load, core): the vectors whose density allows a link.

    distinct: (rep, copies, load).  With one neighbour the core similarity of every vector is 1.
    """
    import numpy as np

    spark = distinct.sparkSession
    model = spark.sparkContext.broadcast(cells)

    def place(batches):
        import pyarrow as pa

        cells = model.value
        for batch in batches:
            ids, many, core = ints(batch.column(0)), ints(batch.column(1)), doubles(batch.column(3))
            load = _bytes(batch.column(2), 2 * dim)
            x = unplanes(load, dim).astype(np.float32)
            if not len(x):
                continue
            x /= np.sqrt((x * x).sum(1))[:, None]
            for s in range(0, len(x), 4096):
                r, c = cells.place(x[s : s + 4096])
                r = r + s
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32)), pa.array(ids[r]), pa.array(many[r]), binary(load[r]), pa.array(core[r])], ["cell", "id", "copies", "load", "core"]
                )

    load = (3, lambda c: unplanes(_bytes(c, 2 * dim), dim))
    vectors = distinct.select("rep", "copies", "load", F.lit(1.0).alias("core"))

    def by_cell(vectors, *columns):
        placed = vectors.mapInArrow(place, "cell int, id bigint, copies bigint, load binary, core double")
        return spread(placed.select("cell", "id", "copies", "load", *columns), "cell").sortWithinPartitions("cell", "id")

    def cores(batches):
        import pyarrow as pa

        for _, (ids, many, x) in sets_of(batches, [(1, ints), (2, ints), load]):
            for at in subcells(x, per_cell, copies, most_cells):
                y = x[at].astype(np.float64)
                size = np.sqrt((y * y).sum(1))
                for s in range(0, len(y), 1024):
                    sim = (y[s : s + 1024] @ y.T) / (size[s : s + 1024, None] * size[None])
                    k = min(min_samples, sim.shape[1])
                    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                    i, j = np.repeat(np.arange(len(sim)), k), top.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at[s + i]]), pa.array(ids[at[j]]), pa.array(np.minimum(sim[i, j], 1.0)), pa.array(many[at[j]])], ["id", "other", "sim", "copies"]
                    )

    cell_key = by_cell(vectors)
    if min_samples > 1:
        # by id: what follows needs no other partitioning
        near = cell_key.mapInArrow(cores, "id bigint, other bigint, sim double, copies bigint")
        near = near.repartition(tasks(spark), "id").groupBy("id", "other").agg(F.max("sim").alias("sim"), F.max("copies").alias("copies"))
        by = Window.partitionBy("id").orderBy(F.desc("sim"), "other").rowsBetween(Window.unboundedPreceding, 0)
        core = near.withColumn("k", F.sum("copies").over(by)).where(F.col("k") >= min_samples).groupBy("id").agg(F.max("sim").alias("core"))
        core = cut_lineage(core.where(F.col("core") >= least).withColumnRenamed("id", "rep"))
        free_shuffles(spark)
        # before vectors are placed: after it there are several rows of each
        vectors = distinct.join(core, "rep").select("rep", "copies", "load", "core")
        cell_key = by_cell(vectors, "core")

    def forests(batches):
        import pyarrow as pa

        extra = [(4, doubles)] if min_samples > 1 else []
        for _, (ids, x, *core) in sets_of(batches, [(1, ints), load, *extra]):
            for at in subcells(x, per_cell, copies, most_cells):
                u, v, w = block_forest(x[at], ids[at], core[0][at] if core else None, least)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(w)], ["u", "v", "w"])

    return cell_key.mapInArrow(forests, "u bigint, v bigint, w double"), vectors.drop("copies")


def _vectors(dim: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = unplanes(_bytes(batch.column(1), 2 * dim), dim).astype(np.float64)
            ends = pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "v"])

    return run


def balls(unit, comp, most: int = 256):
    """(order, starts, centres, cosine of the radius) of tight sets of rows: each component, large ones cut around leaders."""
    order, starts = _ball_rows(unit, comp, most)
    return order, starts, *_ball_bounds(unit[order], starts)


def _ball_rows(unit, comp, most: int = 256):
    import numpy as np

    order = np.argsort(comp, kind="stable")
    key = comp[order]
    starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    sizes = np.diff(starts)
    cuts = [starts[:-1]]
    middle = np.add.reduceat(unit[order], starts[:-1], axis=0) / sizes[:, None] if len(key) else unit[:0]
    wide = np.einsum("ij,ij->i", middle, middle) < WIDE  # mean of all cosines within the component
    for s in np.flatnonzero((sizes > most) | (wide & (sizes > 4))):
        a, b = starts[s], starts[s + 1]
        x = unit[order[a:b]]
        lead = x[:: 4 if wide[s] else most // 2]
        near = np.concatenate([(x[t : t + 4096] @ lead.T).argmax(1) for t in range(0, len(x), 4096)])
        inner = np.argsort(near, kind="stable")
        order[a:b] = order[a:b][inner]
        cuts.append(a + np.flatnonzero(np.diff(near[inner])) + 1)
    return order, np.r_[np.sort(np.concatenate(cuts)), len(order)]


def _ball_bounds(x, starts):
    """Centres and cosines of the radius of balls; x: their rows, one ball after the other."""
    import numpy as np

    starts, sizes = starts[:-1], np.diff(starts)
    centre = np.add.reduceat(x, starts, axis=0) if len(starts) else x[:0]
    centre = centre / np.maximum(np.sqrt((centre * centre).sum(1)), 1e-12)[:, None]
    reach = np.einsum("ij,ij->i", x, np.repeat(centre, sizes, axis=0))
    least = np.minimum.reduceat(reach, starts) if len(starts) else reach
    return centre.astype(np.float32), np.where(sizes == 1, 1.0, least)


class Bounded:
    """Rows in the order of their balls, and the balls: starts, centres, angles of the radius, components."""

    def __init__(self, x, comp, ids, core, starts=None):
        import numpy as np

        self.x, self.comp, self.ids, self.core = x, comp, ids, core
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        self.unit = (x / self.norm[:, None]).astype(np.float32)
        if starts is None:
            order, starts = _ball_rows(self.unit, comp)
            for name in ("x", "comp", "ids", "core", "norm", "unit"):
                setattr(self, name, getattr(self, name)[order])
        self.starts = starts
        self.centre, reach = _ball_bounds(self.unit, starts)
        self.angle = np.where(reach >= 1.0, 0.0, np.arccos(np.clip(reach - 1e-6, -1, 1)))
        self.of = self.comp[starts[:-1]]

    def edges(self, theta: float, left: bool):
        """float32 rows of a product that gives the cosine of two centres less that of both radii and ``theta`` together.

        cos(a + b) is a sum of two products, so the product tests each pair against its own bound.  Balls so wide that the angles
        may add up to more than pi can hold a link with any other.
        """
        import numpy as np

        far = np.where(2 * self.angle + theta >= np.pi, 10.0, 0.0)
        a, each = self.angle + theta * left, np.ones(len(far))
        own = [-np.cos(a), np.sin(a), far, each] if left else [np.cos(a), np.sin(a), each, far]
        return np.ascontiguousarray(np.column_stack([self.centre, *own]), np.float32)


def far_links(x, comp, ids, core, cut: int, least: float):
    """(u, v, w) of the best link between every two components with one end in rows [0, cut) and one in the rest (cut = 0: all with all)."""
    cut = cut or len(x)
    first = Bounded(x[:cut], comp[:cut], ids[:cut], core[:cut])
    return ball_links(first, first if cut == len(x) else Bounded(x[cut:], comp[cut:], ids[cut:], core[cut:]), least)


def ball_links(first: Bounded, second: Bounded, least: float):
    """(u, v, w) of the best link between every two components with one end in ``first`` and one in ``second``, which may be the same.

    Rows are bounded by balls.  Two balls can only hold a link if the angle of their centres is at most both radii and the angle of
    ``least`` together; their rows are compared one by one only then.
    """
    import numpy as np

    one = first is second
    theta = np.arccos(least)
    found = [[], [], []]

    def compare(i, j):
        by = np.argsort(j, kind="stable")
        i, j = i[by], j[by]
        edges = np.r_[0, np.flatnonzero(np.diff(j)) + 1, len(j)]
        for a, b in zip(edges[:-1], edges[1:]):
            start, size = first.starts[i[a:b]], first.starts[i[a:b] + 1] - first.starts[i[a:b]]
            rows = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
            inside = slice(second.starts[j[a]], second.starts[j[a] + 1])
            facing = second.unit[inside].T
            for t in range(0, len(rows), 8192):
                flat = np.flatnonzero(first.unit[rows[t : t + 8192]] @ facing >= least - 1e-5)
                if len(flat):
                    k, m = rows[t + flat // facing.shape[1]], inside.start + flat % facing.shape[1]
                    w = exact_cosines(first.x, first.norm, second.x, second.norm, k, m)
                    w = np.minimum(np.minimum(w, first.core[k]), second.core[m])
                    good = w >= least
                    for c, v in zip(found, (k[good], m[good], w[good])):
                        c.append(v)

    left, right = first.edges(theta, True), second.edges(theta, False)
    held, n = [], 0
    for a in range(0, len(left), 512):
        for b in range(a if one else 0, len(right), 2048):
            room = left[a : a + 512] @ right[b : b + 2048].T
            if room.max() < -1e-4:
                continue
            flat = np.flatnonzero(room >= -1e-4)
            i, j = a + flat // room.shape[1], b + flat % room.shape[1]
            can = first.of[i] != second.of[j]
            if one:
                can &= i < j
            if can.any():
                held.append((i[can], j[can]))
                n += len(held[-1][0])
        if n > 1_000_000 or a + 512 >= len(left) and n:
            compare(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    k, m, w = map(np.concatenate, found)
    u, v = np.minimum(first.ids[k], second.ids[m]), np.maximum(first.ids[k], second.ids[m])
    lo, hi = np.minimum(first.comp[k], second.comp[m]), np.maximum(first.comp[k], second.comp[m])
    by = np.lexsort((u, -w, hi, lo))
    best = by[np.r_[True, (lo[by][1:] != lo[by][:-1]) | (hi[by][1:] != hi[by][:-1])]] if len(by) else by
    return u[best], v[best], w[best]


BLOCK = "block int, comp binary, ids binary, load binary, core binary, starts binary"


def blocks_of(vectors: DataFrame, label: DataFrame, dim: int, per_group: int) -> DataFrame:
    """``BLOCK``: one row per group of components (a large component falls into several), its vectors in the order of their balls.

    comp, ids (int64), load (planes), core (double) and starts (int64) are arrays as bytes.  A group holds about ``per_group`` vectors.
    """
    groups = max(4, -(-vectors.count() // per_group))
    share = max(1, per_group // 4)
    # what is known of a component joins its slim rows first: vectors are shuffled by their row and by their group, no more
    large = label.groupBy("comp").count().where(F.col("count") > share).select("comp", F.ceil(F.col("count") / share).alias("parts"))
    home = label.join(large, "comp", "left").select(F.col("node").alias("rep"), "comp", "parts")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.lit(0))
    rows = vectors.join(home, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).withColumn("part", part)
    rows = rows.select(F.pmod(F.xxhash64("comp", "part"), F.lit(groups)).cast("int").alias("block"), "comp", "rep", "load", "core")
    rows = rows.repartition(min(4_000, groups), "block").sortWithinPartitions("block", "comp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        columns = [(1, ints), (2, ints), (3, lambda c: unplanes(_bytes(c, 2 * dim), dim)), (4, doubles)]
        names = ["block", "comp", "ids", "load", "core", "starts"]
        for key, (comp, ids, x, core) in sets_of(batches, columns):
            b = Bounded(x, comp, ids, core)
            held = [b.comp.astype(np.int64), b.ids.astype(np.int64), planes(np.ascontiguousarray(b.x)), b.core.astype(np.float64), b.starts.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in held]], names)

    return rows.mapInArrow(run, BLOCK)


def links_between(vectors: DataFrame, label: DataFrame, least: float, dim: int, per_group: int = 32_768) -> DataFrame:
    """(u, v, w) with u < v: links >= ``least`` between components, of all pairs of vectors, cells or not.

    vectors: (rep, load, core); label: (node, comp).  Groups of components are written once as blocks (``blocks_of``), and every two
    blocks meet in a task that reads both from the shared folder: disk and shuffle grow as the vectors, not as their pairs.  In a
    meeting the balls around the components are held against each other, and only pairs of balls that can hold a link are
    compared row by row (``ball_links``): for tight components a small part of all pairs.
    """
    blocks = cut_lineage(blocks_of(vectors, label, dim, per_group))
    free_shuffles(blocks.sparkSession)
    # a task holds the blocks of two partitions: at most a dozen each, and up to 64 partitions on either side
    n = blocks.count()
    blocks = blocks.coalesce(max(1, min(n, 64), -(-n // 12)))
    side = lambda k: blocks.select(*[F.col(c).alias(f"{c}{k}") for c in blocks.columns])
    pairs = side(1).join(side(2).hint("shuffle_replicate_nl"), F.col("block1") <= F.col("block2"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def opened(batch, r: int, at: int):
            comp, ids, load, core, starts = (np.frombuffer(batch.column(at + c)[r].as_buffer(), t) for c, t in enumerate(("i8", "i8", "u1", "f8", "i8"), 1))
            return Bounded(unplanes(load.reshape(-1, 2 * dim), dim), comp, ids, core, starts)

        key, first = None, None
        for batch in batches:
            for r, (a, b) in enumerate(zip(ints(batch.column(0)).tolist(), ints(batch.column(6)).tolist())):
                if a != key:
                    key, first = a, opened(batch, r, 0)
                u, v, w = ball_links(first, first if a == b else opened(batch, r, 6), least)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(w)], ["u", "v", "w"])

    return pairs.mapInArrow(run, "u bigint, v bigint, w double")


def hierarchy_rows(
    df: DataFrame, row_id: str, vector: str, least: float, min_size: int, min_samples: int, dim: int | None, per_cell: int = 200, copies: float = 2.5, most_cells: int = 12,
    finish_edges: int = FINISH_EDGES, local_nodes: int = LOCAL_NODES,
) -> tuple[DataFrame, DataFrame]:
    """(id, rep): each usable row and the row that stands for its vector; (rep, root, tier, cluster, stability, joined) of the
    condensed hierarchy (``condense.condensed``), for the vectors in components of at least ``min_size`` rows."""
    dim = vector_length(df, vector) if dim is None else dim
    rows = cut_lineage(compact(df, row_id, vector, dim))
    # copies are folded on the map side already; only one row of each vector is placed
    distinct = cut_lineage(rows.groupBy("load").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")))
    keys = [F.xxhash64("load").alias("h1"), F.xxhash64("load", F.lit(1)).alias("h2")]
    member = cut_lineage(rows.select("id", *keys).distinct().join(distinct.select("rep", *keys), ["h1", "h2"]).select("id", "rep"))
    cells = cells_of(rows, dim, per_cell, copies, most_cells)
    drop_table(rows)
    free_shuffles(df.sparkSession)
    edges, vectors = graph(distinct, cells, least, min_samples, dim, per_cell, copies, most_cells)
    tree, label = boruvka(edges, finish_edges)
    free_shuffles(df.sparkSession)
    # cells may part neighbours: what they leave apart is compared once more
    missed = cut_lineage(links_between(vectors, label, least, dim))
    if not missed.isEmpty():
        tree, label = boruvka(tree.unionByName(missed), finish_edges)
    size = distinct.select(F.col("rep").alias("node"), F.col("copies").alias("size"))
    nodes = size.join(label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "size")
    return member, condensed(tree, nodes, least, min_size, local_nodes).withColumnRenamed("node", "rep")


def density_groups(df: DataFrame, row_id: str, vector: str, least: float = 0.8, min_size: int = 5, dim: int | None = 64, **how) -> DataFrame:
    """(lead, id): the outermost clusters of the hierarchy whose links are cosines >= ``least`` to a nearest neighbour.

    With one neighbour the core similarity is 1, so an outermost cluster is a chain of neighbours of cosine >= ``least``; all
    such chains of at least ``min_size`` rows come out whole.  Every member but the smallest id, which is the lead.
    Unusable vectors (also those not of ``dim`` elements) are in no group; repeated rows count once; an empty table gives an empty result.
    ``dim=None`` reads the length from the data and raises an error where it differs.
    """
    member, clusters = hierarchy_rows(df, row_id, vector, least, min_size, 1, dim, **how)
    found = cut_lineage(member.join(clusters.select("rep", "root"), "rep").select("id", "root"))
    lead = found.groupBy("root").agg(F.min("id").alias("lead"))
    return found.join(lead, "root").where("id <> lead").select("lead", "id")


def hierarchy(
    df: DataFrame, row_id: str, vector: str, least: float = 0.8, min_size: int = 5, min_samples: int = 3, exemplars: int = 3, dim: int | None = 64, **how
) -> tuple[DataFrame, DataFrame]:
    """Stable clusters (cluster_id, n_members, stability, exemplars) and membership (id, cluster_id or NULL).

    The hierarchy holds every merge of mutual reachability >= ``least``; density is 1 / (1 - similarity).  A cluster's id is its
    smallest member.  Exemplars: the members that joined it at the greatest density, ties by id.  Empty in, empty out.
    """
    member, clusters = hierarchy_rows(df, row_id, vector, least, min_size, min_samples, dim, **how)
    key = ["root", "tier", "cluster"]
    inside = cut_lineage(member.join(clusters.where("cluster >= 0"), "rep").select("id", *key, "stability", "joined"))
    by = Window.partitionBy(*key).orderBy(F.desc("joined"), "id")
    typical = inside.withColumn("r", F.row_number().over(by)).where(F.col("r") <= exemplars)
    typical = typical.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("exemplars"))
    sizes = inside.groupBy(*key).agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("n_members"), F.max("stability").alias("stability"))
    out = sizes.join(typical, key).select("cluster_id", "n_members", F.round("stability", 6).alias("stability"), "exemplars")
    owner = inside.join(sizes.select(*key, "cluster_id"), key).select("id", "cluster_id")
    return out, member.select("id").join(owner, "id", "left")
