"""Grouping and nearest vectors against brute force, with copies, ties and unusable vectors."""

import numpy as np
import pytest

from reelspark.llm.cells import make_cells
from reelspark.llm.clusters import balls, compact, density_groups, far_links, hierarchy, links_between, subcells
from reelspark.llm.condense import Condensed, density
from reelspark.llm.forest import block_forest, boruvka, reduce_edges
from reelspark.llm.knn import Searcher, fold_copies, nearest, search_cell
from reelspark.llm.quantise import eta_for, pack, train_codebook, unpack

DIM = 64


def clouds(seed=0, groups=30, lone=120):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = r.normal(size=DIM)
        rows += [c + r.normal(0, 0.25, DIM) for _ in range(int(r.integers(2, 15)))]
    chain = r.normal(size=DIM)
    for _ in range(12):  # neighbours are alike, the ends are not
        rows.append(chain.copy())
        chain = chain + r.normal(0, 0.45, DIM)
    rows += [r.normal(size=DIM) for _ in range(lone)]
    return np.round(np.array(rows), 3)


def odd_rows(first):
    nan = [0.1] * DIM
    nan[3] = float("nan")
    return [(first, None), (first + 1, [0.0] * DIM), (first + 2, nan), (first + 3, [1.0] * 5), (None, [0.5] * DIM), (first + 4, [0.2, None] + [0.1] * (DIM - 2))]


def frame(spark, x, ids=None, extra=()):
    ids = range(1, len(x) + 1) if ids is None else ids
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(ids, x)] + list(extra)
    return spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "id bigint, v array<double>, lead string, comp int")


def components(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[link[i]].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


def test_groups_like_brute_force(spark):
    x = clouds()
    x = np.vstack([x, x[:9], x[5:6]])  # exact copies
    rows = frame(spark, x, extra=[(3, x[2].tolist()), *odd_rows(5000)])
    got = {(r.lead, r.id) for r in density_groups(rows, "id", "v").collect()}
    label = components(x, 0.8)
    want = set()
    for g in np.unique(label):
        ids = np.flatnonzero(label == g) + 1
        if len(ids) >= 5:
            want |= {(int(ids[0]), int(i)) for i in ids[1:]}
    assert got == want and want


def test_groups_that_cells_part(spark, monkeypatch):
    # every row in its nearest cell only: neighbours are parted, and the result must be whole all the same
    monkeypatch.setattr("reelspark.llm.clusters.make_cells", lambda x, n, *_: make_cells(x, n, 12, 1.0, 1))
    r = np.random.default_rng(5)
    chains = np.cumsum(np.concatenate([r.normal(size=(20, 1, DIM)), r.normal(0, 0.45, (20, 29, DIM))], axis=1), axis=1)
    x = np.round(chains.reshape(-1, DIM), 3)
    label = components(x, 0.8)
    want = set()
    for g in np.unique(label):
        ids = np.flatnonzero(label == g) + 1
        if len(ids) >= 5:
            want |= {(int(ids[0]), int(i)) for i in ids[1:]}
    got = {(a.lead, a.id) for a in density_groups(frame(spark, x), "id", "v").collect()}
    assert got == want and want


@pytest.mark.parametrize(("per_cell", "mean", "most"), [(400, 3.5, 12), (800, 3.2, 8)])
def test_slack_beside_a_hot_group(per_cell, mean, most):
    r = np.random.default_rng(3)
    calm = np.repeat(r.normal(size=(400, DIM)), 20, axis=0)
    calm = calm + r.normal(0, 0.4, calm.shape)
    hot = r.normal(size=DIM) + r.normal(0, 0.02, (len(calm) // 2, DIM))
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    alone = make_cells(unit(calm), 200 * per_cell, per_cell, mean, most)
    beside = make_cells(unit(np.vstack([calm, hot])[r.permutation(3 * len(hot))]), 300 * per_cell, per_cell, mean, most)
    x = unit(calm[::4]).astype(np.float32)
    copies = lambda c: len(c.place(x)[0]) / len(x)
    assert copies(beside) > 0.7 * copies(alone)


def test_chains_at_the_threshold(spark):
    # links of cosine 0.82 and nothing closer: six vectors a chain
    r = np.random.default_rng(11)
    rows = []
    for _ in range(700):
        v = r.normal(size=DIM)
        v /= np.linalg.norm(v)
        for _ in range(6):
            rows.append(v)
            step = r.normal(size=DIM)
            step -= (step @ v) * v
            v = 0.82 * v + np.sqrt(1 - 0.82**2) * step / np.linalg.norm(step)
    x = np.round(np.array(rows)[r.permutation(len(rows))], 3)
    label = components(x, 0.8)
    want = set()
    for g in np.unique(label):
        ids = np.flatnonzero(label == g) + 1
        if len(ids) >= 5:
            want |= {(int(ids[0]), int(i)) for i in ids[1:]}
    got = {(a.lead, a.id) for a in density_groups(frame(spark, x), "id", "v").collect()}
    assert got == want and len(want) > 2000


def test_far_links_like_all_pairs():
    r = np.random.default_rng(2)
    tops = np.repeat(r.normal(size=(40, DIM)), 30, axis=0)
    x = np.rint(1000 * np.vstack([tops + r.normal(0, 0.45, tops.shape), np.cumsum(r.normal(0, 0.45, (700, DIM)), 0), r.normal(size=(60, DIM))])).astype(np.int16)
    x = x[(x != 0).any(1)]
    ids = r.permutation(len(x)) + 10
    core = np.where(r.random(len(x)) < 0.1, 0.81, 1.0)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sim = np.minimum(np.minimum(unit @ unit.T, core[:, None]), core[None])
    comp = np.where(np.arange(len(x)) < 1200, np.arange(len(x)) // 13, np.where(np.arange(len(x)) < 1900, 500, np.arange(len(x)) + 1000))
    for cut in (0, 910):
        best = {}
        rows, cols = (range(len(x)), range(len(x))) if cut == 0 else (range(cut), range(cut, len(x)))
        for i in rows:
            for j in cols:
                if comp[i] != comp[j] and sim[i, j] >= 0.8:
                    k = tuple(sorted((int(comp[i]), int(comp[j]))))
                    best[k] = max(best.get(k, 0), round(float(sim[i, j]), 9))
        u, v, w = far_links(x, comp, ids, core, cut, 0.8)
        at = {int(i): int(c) for i, c in zip(ids, comp)}
        assert {tuple(sorted((at[int(a)], at[int(b)]))): round(float(c), 9) for a, b, c in zip(u, v, w)} == best and best
    order, starts, _, _ = balls(unit.astype(np.float32), comp, 32)
    assert sorted(order) == list(range(len(x))) and max(np.diff(starts)) < 700


def test_links_between_ships_a_vector_but_twice(spark):
    """Disk grows as the vectors, however many groups meet; every link between components is found."""
    r = np.random.default_rng(5)
    x = np.rint(1000 * np.vstack([np.repeat(r.normal(size=(300, DIM)), 6, axis=0) + r.normal(0, 0.4, (1800, DIM)), r.normal(size=(1200, DIM))])) / 1000
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    ids = r.permutation(len(x)) + 10
    comp = ids.reshape(-1, 3).min(1).repeat(3)  # half of a group each
    comp[1800:] = ids[1800:]
    vectors = compact(frame(spark, x, ids), "id", "v", DIM).selectExpr("id rep", "load", "1.0D core").localCheckpoint()
    label = spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids[:1800], comp)], "node bigint, comp bigint").localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    found = links_between(vectors, label, 0.8, DIM, per_group=100).collect()
    assert written() - before < 4 * len(x) * 2 * DIM
    best = {}
    for i, j in zip(*np.nonzero(np.triu(sim >= 0.8, 1))):
        if comp[i] != comp[j]:
            k = tuple(sorted((int(comp[i]), int(comp[j]))))
            best[k] = max(best.get(k, 0), round(float(sim[i, j]), 9))
    at = {int(i): int(c) for i, c in zip(ids, comp)}
    got = {}
    for u, v, w in found:
        k = tuple(sorted((at[u], at[v])))
        got[k] = max(got.get(k, 0), round(w, 9))
    assert len(best) > 100 and got == best


def plain_hierarchy(sim, size, least, m):
    """Stable clusters as sets of rows, from the components at every similarity."""
    n = len(sim)

    def comps(rows, t, strict):
        rest, out = set(rows), []
        while rest:
            seen, todo = set(), [rest.pop()]
            while todo:
                i = todo.pop()
                seen.add(i)
                near = [j for j in rest if (sim[i, j] > t if strict else sim[i, j] >= t)]
                rest.difference_update(near)
                todo += near
            out.append(frozenset(seen))
        return out

    def best(rows, birth):
        """(stability, chosen sets) of the cluster ``rows`` that begins at density ``birth``."""
        gone, live = 0.0, rows
        while True:
            inner = [sim[i, j] for i in live for j in live if i < j]
            bridge = [t for t in sorted(set(inner)) if len(comps(live, t, True)) > 1]
            big_alone = size[list(live)].sum() >= m and len(live) == 1
            if not bridge:
                gone += size[list(live)].sum() * density(1.0) if big_alone else 0
                return max(gone - size[list(rows)].sum() * birth, 0 if not big_alone else -1e18), [rows]
            t = bridge[0]
            d = density(t)
            parts = comps(live, t, True)
            big = [p for p in parts if size[list(p)].sum() >= m]
            left = size[list(live)].sum()
            if not big:
                gone += left * d
                return gone - size[list(rows)].sum() * birth, [rows]
            if len(big) == 1:
                gone += (left - size[list(big[0])].sum()) * d
                live = big[0]
                continue
            gone += left * d
            own = gone - size[list(rows)].sum() * birth
            inner = [best(p, d) for p in big]
            if own >= sum(b for b, _ in inner):
                return own, [rows]
            return sum(b for b, _ in inner), [c for _, cs in inner for c in cs]

    out = []
    for c in comps(range(n), least, False):
        if size[list(c)].sum() >= m:
            out += best(c, density(least))[1]
    return set(out)


@pytest.mark.parametrize("seed", range(6))
def test_condensed_like_plain(seed):
    r = np.random.default_rng(seed)
    n = 60
    x = np.repeat(r.normal(size=(4, 6)), 15, axis=0) + np.repeat(r.normal(0, 0.25, (12, 6)), 5, axis=0) + r.normal(0, 0.12, (n, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 2 if seed % 2 else 6)  # with many ties
    size = r.integers(1, 3, n) if seed % 3 else np.ones(n, int)
    i, j = np.nonzero(np.triu(sim >= 0.8, 1))
    keep, label = reduce_edges(i, j, sim[i, j], n)
    c = Condensed(size.tolist(), 4).run(i[keep], j[keep], sim[i, j][keep], 0.8)
    mine: dict = {}
    for k in range(n):
        o = c.owner[c.leaf[k]] if c.leaf[k] >= 0 else -1
        if o >= 0:
            mine.setdefault(o, set()).add(k)
    assert set(map(frozenset, mine.values())) == plain_hierarchy(sim, size, 0.8, 4)


def test_hierarchy_in_pieces_and_rounds(spark):
    # distributed rounds, cells within cells and components cut into pieces change nothing
    x = clouds(9, groups=25, lone=40)
    r = np.random.default_rng(1)
    hot = np.repeat(r.normal(size=(1, DIM)), 300, axis=0) + np.repeat(r.normal(0, 0.2, (20, DIM)), 15, axis=0) + r.normal(0, 0.12, (300, DIM))
    x = np.round(np.vstack([x, hot, hot[:6]]), 3)
    rows = frame(spark, x, extra=odd_rows(9000))
    for samples in (1, 3):
        a, b = (hierarchy(rows, "id", "v", min_samples=samples, per_cell=100, **how) for how in ({}, {"finish_edges": 50, "local_nodes": 40}))
        whole = {(c.cluster_id, c.n_members, round(c.stability, 3), tuple(c.exemplars)) for c in a[0].collect()}
        assert whole and whole == {(c.cluster_id, c.n_members, round(c.stability, 3), tuple(c.exemplars)) for c in b[0].collect()}
        assert {(m.id, m.cluster_id) for m in a[1].collect()} == {(m.id, m.cluster_id) for m in b[1].collect()}


def test_large_cells_have_cells_of_their_own(monkeypatch):
    monkeypatch.setattr("reelspark.llm.clusters.MOST_IN_CELL", 500)
    x = np.rint(1000 * clouds(4, groups=200, lone=200)).astype(np.int16)
    sets = subcells(x, 100, 2.5, 12)
    assert len(sets) > 5 and set(np.concatenate(sets)) == set(range(len(x)))
    ids = np.arange(len(x))
    whole = {(a, b) for a, b in zip(*block_forest(x, ids, None, 0.8)[:2])}
    parts = {(a, b) for s in sets for a, b in zip(*block_forest(x[s], ids[s], None, 0.8)[:2])}
    assert len(whole & parts) > 0.95 * len(whole)


def test_nothing_and_all_alike(spark):
    assert density_groups(frame(spark, []), "id", "v").count() == 0
    same = frame(spark, np.tile(clouds()[:1], (300, 1)))
    assert {(r.lead, r.id) for r in density_groups(same, "id", "v").collect()} == {(1, i) for i in range(2, 301)}


def test_hierarchy_finds_nested_clusters(spark):
    r = np.random.default_rng(4)
    tops = r.normal(size=(6, DIM))
    x = np.vstack([t + r.normal(0, 0.12, (20, DIM)) for t in tops] + [r.normal(size=(30, DIM))])
    clusters, members = hierarchy(frame(spark, x, extra=odd_rows(9000)), "id", "v")
    got = {c.cluster_id: c for c in clusters.collect()}
    owner = {m.id: m.cluster_id for m in members.collect()}
    assert len(got) == 6 and all(c.n_members == 20 and len(c.exemplars) == 3 for c in got.values())
    assert all(owner[i] is None for i in range(121, 151)) and len(owner) == 150
    assert all(len({owner[1 + 20 * k + j] for j in range(20)}) == 1 for k in range(6))
    assert all(owner[e] == c for c, row in got.items() for e in row.exemplars)


def kruskal(edges):
    parent: dict = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    out = set()
    for u, v, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = root(u), root(v)
        if a != b:
            parent[a] = b
            out.add((u, v))
    return out


@pytest.mark.parametrize("bound", [1, 10_000])
def test_forests_like_kruskal(spark, bound):
    r = np.random.default_rng(8)
    edges = {}
    for _ in range(900):
        u, v = sorted(r.choice(250, 2, replace=False).tolist())
        edges[(u, v)] = float(np.round(r.random(), 2))  # many ties
    edges |= {(i, i + 1): 0.5 for i in range(300, 340)}  # a long chain of equal weights
    rows = [(u, v, w) for (u, v), w in edges.items()]
    u, v, w = map(np.array, zip(*rows))
    keep, label = reduce_edges(u, v, w, 400)
    assert {(int(u[k]), int(v[k])) for k in keep} == kruskal(rows)
    tree, comp = boruvka(spark.createDataFrame(rows, "u bigint, v bigint, w double"), bound)
    got = {(t.u, t.v) for t in tree.collect()}
    assert got == kruskal(rows)
    parts: dict = {}
    for n in comp.collect():
        parts.setdefault(n.comp, set()).add(n.node)
    assert {frozenset(p) for p in parts.values()} == {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label[[*{*u, *v}]])}


def test_block_forest_in_small_blocks():
    x = np.rint(clouds(2) * 1000).astype(np.int16)
    ids = np.arange(len(x)) * 3
    a = block_forest(x, ids, None, 0.8)
    b = block_forest(x, ids, None, 0.8, block=37)
    assert np.allclose(sorted(a[2]), sorted(b[2])) and len(a[0])


def test_codebook_keeps_the_parallel_part():
    x = clouds(3, groups=60, lone=900)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    book = train_codebook(x, 32, 0.92)
    codes = book.encode(x)
    assert (unpack(pack(codes)) == codes).all()
    err = x - book.decode(codes)
    along = np.abs((err * x).sum(1))
    plain = x - book.decode(book.encode(x, 0))
    assert along.mean() < 0.5 * np.abs((plain * x).sum(1)).mean() and eta_for(0.92, 64) > 300


def brute(items, queries, k, least):
    ids, x = items
    want = set()
    for q, v in queries:
        sim = x @ v
        order = sorted((-round(float(s), 12), int(i)) for i, s in zip(ids, sim) if i != q and s >= least - 1e-12)
        want |= {(q, i) for _, i in order[:k]}
    return want


@pytest.mark.parametrize("copies", [0, 400])
def test_nearest_recall(spark, copies):
    x = clouds(7, groups=120, lone=1500)
    if copies:
        x = np.vstack([x, np.tile(x[10:11], (copies, 1))])
    ids = np.arange(1, len(x) + 1)
    q = np.round(x[::7] + 0.01, 3)
    qids = np.arange(100_001, 100_001 + len(q))
    items, queries = frame(spark, x, ids, [(5, x[4].tolist()), *odd_rows(50_000)]), frame(spark, q, qids, odd_rows(200_000))
    rows = nearest(items, queries, "id", "v", per_cell=64).collect()
    got = {(r.query_id, r.item_id) for r in rows}
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    u, w = unit(x), unit(q)
    want = brute((ids, u), [*zip(ids.tolist(), u), *zip(qids.tolist(), w)], 5, 0.92)
    assert len(want & got) / len(want) >= 0.95
    # only a missed neighbour lets a further one in, and every cosine is exact
    vector = lambda i: u[i - 1] if i < 100_000 else w[i - 100_001]
    assert all(r.cosine >= 0.92 and abs(r.cosine - vector(r.query_id) @ vector(r.item_id)) < 1e-9 for r in rows)
    assert len(rows) == len(got) and max(sum(1 for a, _ in got if a == i) for i in (1, 5, 11)) <= 5


def test_cell_of_near_equal_frames():
    r = np.random.default_rng(6)
    x = np.vstack([r.normal(size=DIM) + r.normal(0, 0.155, (3000, DIM)), r.normal(size=(500, DIM))])
    x = np.vstack([x, np.tile(x[7:8], (100, 1))])
    v = np.rint(x * 1000).astype(np.int16)
    unit = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    book = train_codebook(unit[::4], 32, 0.92)
    approx = book.decode(book.encode(unit.astype(np.float32)))
    ids = np.arange(1, len(v) + 1)
    keep = fold_copies(v, ids, 6)
    q = np.r_[0:3000:30, 7, 3500:3600]
    a, b, _ = search_cell(v[q], ids[q], v[keep], ids[keep], approx[keep], 5, 0.92, 32)
    assert set(zip(a.tolist(), b.tolist())) == brute((ids, unit), [(int(ids[i]), unit[i]) for i in q], 5, 0.92)


@pytest.mark.parametrize("spread", [0.02, 0.12])
def test_nearest_beside_a_hot_source(spark, spread):
    r = np.random.default_rng(14)
    calm = np.repeat(r.normal(size=(100, DIM)), 20, axis=0)
    calm = calm + r.normal(0, 0.24, calm.shape)
    x = np.vstack([calm, r.normal(size=DIM) + r.normal(0, spread, (1000, DIM))])
    x = np.round(x[r.permutation(len(x))], 3)
    ids = np.arange(1, len(x) + 1)
    got = {(a.query_id, a.item_id) for a in nearest(frame(spark, x, ids), None, "id", "v", per_cell=48).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = brute((ids, u), [*zip(ids.tolist(), u)], 5, 0.92)
    assert len(want & got) / len(want) >= 0.9


def near_threshold(r, groups, size):
    """Groups whose members have cosines of 0.92 to 0.935 to each other."""
    rows = []
    for _ in range(groups):
        c = r.normal(size=DIM)
        c /= np.linalg.norm(c)
        for t in np.sqrt(r.uniform(0.92, 0.935, size)):
            e = r.normal(size=DIM)
            e -= (e @ c) * c
            rows.append(t * c + np.sqrt(1 - t * t) * e / np.linalg.norm(e))
    return np.round(np.array(rows), 3)


def test_nearest_at_the_threshold(spark):
    r = np.random.default_rng(21)
    x = near_threshold(r, 1000, 12)
    ids = np.arange(1, len(x) + 1)
    got = {(a.query_id, a.item_id) for a in nearest(frame(spark, x, ids), None, "id", "v", per_cell=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = brute((ids, u), [*zip(ids.tolist(), u)], 5, 0.92)
    assert len(want) > 5000 and len(want & got) / len(want) >= 0.95


def test_ties_of_shared_vectors(spark):
    # vectors on 100 rows each: every row's five nearest are the five smallest other ids of its copies
    r = np.random.default_rng(3)
    x = np.round(np.vstack([np.repeat(r.normal(size=(3, DIM)), 100, axis=0), r.normal(size=(4000, DIM))]), 3)
    ids = r.permutation(len(x)) + 1
    got: dict = {}
    for a in nearest(frame(spark, x, ids), None, "id", "v").collect():
        got.setdefault(a.query_id, set()).add(a.item_id)
    for g in range(3):
        mine = sorted(ids[100 * g : 100 * g + 100].tolist())
        assert all(got[i] == set([m for m in mine if m != i][:5]) for i in mine)


def test_large_cell_is_searched_by_cells(monkeypatch):
    monkeypatch.setattr("reelspark.llm.knn.MOST_IN_CELL", 600)
    r = np.random.default_rng(5)
    v = np.rint(1000 * near_threshold(r, 200, 10)).astype(np.int16)
    u = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    book = train_codebook(u, 32, 0.92)
    ids = np.arange(1, len(v) + 1)
    s = Searcher(v, ids, book.decode(book.encode(u.astype(np.float32))), 5, 100, 3.6, 12)
    assert s.cells is not None
    a, b, _ = s.search(v, ids, 5, 0.92, 32)
    want = brute((ids, u), [*zip(ids.tolist(), u)], 5, 0.92)
    assert len(want & set(zip(a.tolist(), b.tolist()))) / len(want) > 0.95


def test_nearest_of_nothing(spark):
    assert nearest(frame(spark, []), frame(spark, clouds()[:3]), "id", "v").count() == 0
    assert nearest(frame(spark, clouds()[:1]), None, "id", "v").count() == 0


def test_length_read_from_the_data(spark):
    x = np.round(np.random.default_rng(1).normal(size=(40, 6)), 3)
    x = np.vstack([x, np.repeat(x[:3], 6, axis=0) + 0.001])
    rows = frame(spark, x, extra=[(900, None), (901, [])])
    assert nearest(rows, None, "id", "v", dim=None).count() > 0 and density_groups(rows, "id", "v", least=0.999, dim=None).count() >= 15
    with pytest.raises(ValueError, match="6 to 7"):
        nearest(frame(spark, x, extra=[(900, [1.0] * 7)]), None, "id", "v", dim=None)
