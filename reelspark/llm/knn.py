"""Most similar vectors for every vector, by anisotropic four-bit codes and exact reranking.

One wide shuffle: every vector is placed in the cells near it (``cells``), with its coordinates as 16-bit
integers and, where it belongs to the index, its four-bit codes (``quantise``).  In each cell the codes are decoded
once through their tables and scanned against the cell's queries in blocks; what may reach the threshold
by the bound of its code's error is reranked with the exact coordinates, and the cells' short lists are merged per query.
Cells that outgrow ``MOST_IN_CELL`` are searched through cells of their own, so the cost per vector does not grow with the collection.

Vectors that many rows share exactly are found in the sample and leave the bulk: the index keeps the few smallest
ids of each (more can never be among the nearest), the vector itself is searched once, and its rows get that answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import binary, ints, matrix
from reelspark.llm.cells import bounded_sample, make_cells, vector_length
from reelspark.llm.quantise import pack, train_codebook, unpack
from reelspark.operators.ordering import spread

MAX_HOT = 256  # shared vectors that are handled apart; bounds what is broadcast of them
MOST_IN_CELL = 4096  # items of a cell above which it is searched through cells of its own
INDEX_ONLY, BOTH, QUERY = 0, 1, 2


def to_int16(x):
    """Rows as integers: thousandths where that is exact, else scaled to the full range; cosines keep."""
    import numpy as np

    top = np.abs(x).max(1, keepdims=True)
    milli = np.rint(x * 1000)
    exact = (top < 32.7) & (np.abs(x * 1000 - milli).max(1, keepdims=True) < 1e-6)
    return np.where(exact, milli, np.rint(x * (32767 / np.maximum(top, 1e-300)))).astype(np.int16)


def planes(v):
    """Low bytes, then high bytes: the high ones are nearly constant and compress."""
    import numpy as np

    u = v.view(np.uint16)
    return np.concatenate([(u & 255).astype(np.uint8), (u >> 8).astype(np.uint8)], 1)


def unplanes(b, dim):
    import numpy as np

    return (b[:, :dim].astype(np.uint16) | (b[:, dim : 2 * dim].astype(np.uint16) << 8)).view(np.int16)


def fold_copies(d, did, most: int):
    """Positions of the ``most`` smallest ids of each distinct row of d, each id once: no query can need more of them."""
    import numpy as np

    row = np.ascontiguousarray(d).view(f"V{d.shape[1] * d.itemsize}").ravel()
    _, kind = np.unique(row, return_inverse=True)
    order = np.lexsort((did, kind))
    kind, ids = kind[order], did[order]
    again = np.r_[False, (kind[1:] == kind[:-1]) & (ids[1:] == ids[:-1])]
    order, kind = order[~again], kind[~again]
    first = np.r_[True, kind[1:] != kind[:-1]]
    at = np.arange(len(kind))
    return np.sort(order[at - np.maximum.accumulate(np.where(first, at, 0)) < most])


def search_cell(q, qid, d, did, approx, k: int, least: float, depth: int):
    """Short lists of one cell: (query id, item id, cosine) of exact cosine >= ``least``, at most k a query.

    q, d: int16 coordinates, of d each vector at most k + 1 times (``fold_copies``); approx: decoded codes of d.  No item is
    lost to the codes.  With e = d - approx, a = d.e and b = |e across d|, an item of cosine t scores at least
    t (1 - a) - sqrt(1 - t^2) b, which grows with t; so what scores below that at ``least`` is out.  Where more than
    ``depth`` items of a query and block remain, the exact vectors tell which of them are the k + 1 best, with all ties.
    """
    import numpy as np

    qf, df = q.astype(np.float32), d.astype(np.float32)
    qf /= np.sqrt((qf * qf).sum(1))[:, None]
    df /= np.sqrt((df * df).sum(1))[:, None]
    d64, q64 = d.astype(np.float64), q.astype(np.float64)
    dn, qn = (d64 * d64).sum(1), (q64 * q64).sum(1)
    err = df - approx
    along = (err * df).sum(1)
    across = np.sqrt(np.maximum((err * err).sum(1) - along * along, 0))
    floor = np.where(along < 1, least * (1 - along) - np.sqrt(max(1 - least * least, 0)) * across, -np.inf) - 1e-5
    rows, cols = [], []
    for a in range(0, len(q), 1024):
        for b in range(0, len(d), 8192):
            block = approx[b : b + 8192]
            flat = np.flatnonzero(qf[a : a + 1024] @ block.T >= floor[b : b + 8192])
            r, c = flat // len(block), flat % len(block)
            many = np.flatnonzero(np.bincount(r) > max(depth, k + 1))
            if len(many):
                true = qf[a + many] @ df[b : b + 8192].T
                best = -np.partition(-true, k, axis=1)[:, k]
                i, j = np.nonzero(true >= np.maximum(best, least)[:, None] - 1e-5)
                few = ~np.isin(r, many)
                r, c = np.r_[r[few], many[i]], np.r_[c[few], j]
            rows.append(r + a)
            cols.append(c + b)
    r, c = np.concatenate(rows), np.concatenate(cols)
    keep = qid[r] != did[c]
    r, c = r[keep], c[keep]
    sim = np.empty(len(r))
    for s in range(0, len(r), 65536):
        e = slice(s, s + 65536)
        sim[e] = np.einsum("ij,ij->i", q64[r[e]], d64[c[e]]) / np.sqrt(qn[r[e]] * dn[c[e]])
    good = sim >= least
    r, c, sim = r[good], c[good], sim[good]
    order = np.lexsort((did[c], -sim, r))
    r, c, sim = r[order], c[order], sim[order]
    # an item that came twice (a repeated row) counts once
    same = np.zeros(len(r), bool)
    same[1:] = (r[1:] == r[:-1]) & (did[c[1:]] == did[c[:-1]])
    r, c, sim = r[~same], c[~same], sim[~same]
    first = np.r_[0, np.flatnonzero(r[1:] != r[:-1]) + 1] if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) if len(r) else np.zeros(0, int)
    top = rank < k
    return qid[r[top]], did[c[top]], sim[top]


class Searcher:
    """A cell's items: copies folded, and cells of its own where there are more than ``MOST_IN_CELL`` of them."""

    def __init__(self, d, did, approx, k: int, per_cell: int, copies: float, most: int):
        import numpy as np

        keep = fold_copies(d, did, k + 2)
        self.d, self.did, self.approx, self.cells = d[keep], did[keep], approx[keep], None
        if len(self.d) > MOST_IN_CELL:
            unit = self._unit(self.d)
            self.cells = make_cells(unit[:: -(-len(unit) // 8192)], len(unit), per_cell, copies, most)
            r, c = self.cells.place(unit)
            order = np.argsort(c, kind="stable")
            cut = np.flatnonzero(np.diff(c[order])) + 1
            self.inside = dict(zip(c[order][np.r_[0, cut]].tolist(), np.split(r[order], cut)))

    @staticmethod
    def _unit(v):
        import numpy as np

        x = v.astype(np.float32)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def search(self, q, qid, k: int, least: float, depth: int):
        import numpy as np

        if self.cells is None:
            return search_cell(q, qid, self.d, self.did, self.approx, k, least, depth)
        r, c = self.cells.place(self._unit(q))
        order = np.argsort(c, kind="stable")
        found = []
        for rows, cell in zip(np.split(r[order], np.flatnonzero(np.diff(c[order])) + 1), np.unique(c).tolist()):
            if cell in self.inside:
                i = self.inside[cell]
                found.append(search_cell(q[rows], qid[rows], self.d[i], self.did[i], self.approx[i], k, least, depth))
        return tuple(map(np.concatenate, zip(*found))) if found else (qid[:0], qid[:0], np.zeros(0))


def nearest(
    index: DataFrame,
    queries: DataFrame | None,
    row_id: str,
    vector: str,
    k: int = 5,
    least: float = 0.92,
    dim: int | None = 64,
    per_cell: int = 400,
    copies: float = 3.2,
    most_cells: int = 8,
    depth: int = 32,
) -> DataFrame:
    """(query_id, item_id, cosine): of the k most similar other index vectors of each vector those >= ``least``.

    Every usable vector of ``index`` is both item and query; those of ``queries`` are queries only.  Ids must not
    coincide between the two.  Equal cosines go by the smaller item id.  Unusable vectors (NULL, wrong length, all zero,
    with NULL, NaN or infinity) and NULL ids are left out; repeated rows count once.  The result is approximate:
    neighbours that share no cell are missed, those that share one are all found.  Cosines are those of the vectors as 16-bit integers: exact
    for values of at most three decimals below 32.7, else within 1e-4.  ``dim=None`` reads the length and raises an error where it differs.
    """
    import numpy as np

    spark = index.sparkSession
    if dim is None:
        dim = vector_length(index if queries is None else index.select(vector).unionByName(queries.select(vector)), vector)
    n = index.select(row_id).count()
    full = -(-dim // 4) * 4  # codes come in bytes of two, so vectors are filled up with zeros

    def wide(column):
        x, ok = matrix(column, dim, "float64")
        return np.pad(x, ((0, 0), (0, full - dim))), ok

    sample = np.pad(bounded_sample(index, row_id, vector, n, dim), ((0, 0), (0, full - dim)))
    schema = "query_id bigint, item_id bigint, cosine double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    whole = to_int16(sample)
    shared, times = np.unique(whole, axis=0, return_counts=True)
    hot = shared[np.argsort(-times, kind="stable")][: min(MAX_HOT, int((times >= max(32, len(whole) // 200)).sum()))]
    norm = whole / np.sqrt((whole.astype(np.float64) ** 2).sum(1))[:, None]
    cells = make_cells(norm, n, per_cell, copies, most_cells)
    book = train_codebook(norm[:: max(1, len(norm) // 8192)], full // 2, max(least, 0.2))
    shared_model = spark.sparkContext.broadcast((cells, book, {h.tobytes(): i for i, h in enumerate(hot)}))
    width = 2 * full

    def place(role: int):
        def run(batches):
            import pyarrow as pa

            cells, book, hot = shared_model.value
            least_ids: dict[int, list[int]] = {}

            def emit(v, ids, role):
                x = v.astype(np.float32)
                x /= np.sqrt((x * x).sum(1))[:, None]
                load = planes(v)
                if role != QUERY:
                    load = np.concatenate([load, pack(book.encode(x))], 1)
                r, c = cells.place(x)
                return pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32)), pa.array(np.full(len(r), role, np.int32)), pa.array(ids[r]), binary(load[r])],
                    ["cell", "role", "id", "load"],
                )

            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = ints(batch.column(0))
                x, ok = wide(batch.column(1))
                v, ids = to_int16(x[ok]), ids[ok]
                if hot and len(v):
                    mine = np.array([hot.get(b.tobytes(), -1) for b in v])
                    if role == BOTH:
                        for h in np.unique(mine[mine >= 0]):
                            least_ids[h] = sorted({*least_ids.get(h, []), *ids[mine == h].tolist()})[: k + 1]
                    v, ids = v[mine < 0], ids[mine < 0]
                for s in range(0, len(v), 4096):
                    yield emit(v[s : s + 4096], ids[s : s + 4096], role)
            if least_ids:
                back = {i: np.frombuffer(b, np.int16) for b, i in hot.items()}
                pairs = [(h, i) for h, some in least_ids.items() for i in some]
                yield emit(np.stack([back[h] for h, _ in pairs]), np.array([i for _, i in pairs], np.int64), INDEX_ONLY)

        return run

    place_schema = "cell int, role int, id bigint, load binary"

    def slim(df):
        return df.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    placed = slim(index).mapInArrow(place(BOTH), place_schema)
    if queries is not None:
        placed = placed.unionByName(slim(queries).mapInArrow(place(QUERY), place_schema))
    if len(hot):
        # each shared vector asks once, under an id below all others: -(2^62) + its number
        asks = spark.createDataFrame([(-(2**62) + i, [float(a) for a in h]) for i, h in enumerate(hot)], "id bigint, v array<double>")

        def ask(batches):
            import pyarrow as pa

            cells, _, _ = shared_model.value
            for batch in batches:
                if batch.num_rows:
                    ids, v = ints(batch.column(0)), matrix(batch.column(1), full, "float64")[0].astype(np.int16)
                    r, c = cells.place((v / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]).astype(np.float32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(np.int32)), pa.array(np.full(len(r), QUERY, np.int32)), pa.array(ids[r]), binary(planes(v)[r])],
                        ["cell", "role", "id", "load"],
                    )

        placed = placed.unionByName(asks.mapInArrow(ask, place_schema))
    sorted_cells = spread(placed, "cell").sortWithinPartitions("cell", "role")

    def scan(batches):
        import pyarrow as pa

        _, book, _ = shared_model.value
        cell, items, folded = None, [], []

        def answer(q, qid):
            if not items or not len(q):
                return None
            if len(items) > 1:
                items[:] = [tuple(np.concatenate(a) for a in zip(*items))]
            if not folded:
                folded.append(Searcher(*items[0], k, per_cell, copies, most_cells))
            a, b, s = folded[0].search(q, qid, k + int((qid < -(2**61)).any()), least, depth)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "item_id", "cosine"])

        def finish():
            # the index vectors of a cell are its queries, too
            if items:
                both = np.concatenate([r for *_, r in roles]) if roles else np.zeros(0, bool)
                if len(items) > 1:
                    items[:] = [tuple(np.concatenate(a) for a in zip(*items))]
                d, did, _ = items[0]
                return answer(d[both], did[both])
            return None

        roles: list = []
        for batch in batches:
            cs, rs, ids = ints(batch.column(0)), ints(batch.column(1)), ints(batch.column(2))
            edges = np.r_[0, np.flatnonzero((np.diff(cs) != 0) | (np.diff(rs) != 0)) + 1, len(cs)] if len(cs) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if cell != cs[a]:
                    if (out := finish()) is not None:
                        yield out
                    cell, items[:], folded[:], roles = cs[a], [], [], []
                raw = batch.column(3).slice(a, b - a)
                if rs[a] == QUERY:
                    if (out := answer(unplanes(_bytes(raw, width), full), ids[a:b])) is not None:
                        yield out
                else:
                    u = _bytes(raw, width + full // 4)
                    items.append((unplanes(u, full), ids[a:b], book.decode(unpack(u[:, width:]))))
                    roles.append((np.full(b - a, rs[a] == BOTH),))
        if (out := finish()) is not None:
            yield out

    found = sorted_cells.select("cell", "role", "id", "load").mapInArrow(scan, schema)
    # cosines come from integers, so the same pair has the same value in every cell
    by_query = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id")
    best = found.dropDuplicates(["query_id", "item_id"]).withColumn("r", F.row_number().over(by_query))
    if not len(hot):
        return best.where(F.col("r") <= k).drop("r")
    plain = best.where((F.col("query_id") > -(2**61)) & (F.col("r") <= k)).drop("r")
    # at most MAX_HOT rows of k + 1 answers, so this side may be broadcast
    answers = F.broadcast(
        best.where((F.col("query_id") < -(2**61)) & (F.col("r") <= k + 1))
        .groupBy((F.col("query_id") + 2**62).cast("int").alias("h"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("less"), "item_id"))).alias("found"))
    )

    def members(batches):
        import pyarrow as pa

        _, _, hot = shared_model.value
        for batch in batches:
            ids = ints(batch.column(0))
            x, ok = wide(batch.column(1))
            v, ids = to_int16(x[ok]), ids[ok]
            h = np.array([hot.get(b.tobytes(), -1) for b in v], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[h >= 0]), pa.array(h[h >= 0])], ["id", "h"])

    rows = slim(index) if queries is None else slim(index).unionByName(slim(queries))
    of_hot = rows.mapInArrow(members, "id bigint, h int").join(answers, "h")
    others = F.slice(F.filter("found", lambda f: f["item_id"] != F.col("id")), 1, k)
    shared_rows = of_hot.select(F.col("id").alias("query_id"), F.explode(others).alias("f")).select(
        "query_id", F.col("f.item_id").alias("item_id"), (-F.col("f.less")).alias("cosine")
    )
    return plain.unionByName(shared_rows.distinct())


def _bytes(column, width: int):
    from reelspark.functions.arrow_vectors import from_binary

    return from_binary(column, width, "uint8")
