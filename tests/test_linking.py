import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import clusters as U, detections as T, linking as L, spatial as P
from lociflow.operators.graph import connected_components

LOC = "recording_id long, loc_id long, frame int, x double, y double, mass double"


def field(seed, frames=12, spots=14, size=40.0, rec=2):
    rng = np.random.default_rng(seed)
    out, k = [], 0
    for r in range(rec):
        pos = rng.uniform(0, size, (spots, 2))
        for f in range(frames):
            pos = pos + rng.normal(0, 1.5, pos.shape)
            for x, y in pos[rng.random(spots) > 0.2]:
                out.append((r, k, f, float(x), float(y), float(rng.uniform(1, 5))))
                k += 1
    return out


def partition(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r.recording_id, r.particle), set()).add(r.loc_id)
    return sorted(map(sorted, groups.values()))


def online(rows, radius, max_gap, choose):
    """Frame by frame with all pairs, as a check of the distributed linkers."""
    tracks = []
    for rec in sorted({r[0] for r in rows}):
        active = []
        for f in sorted({r[2] for r in rows if r[0] == rec}):
            active = [t for t in active if f - t["last"] <= max_gap]
            det = sorted(r for r in rows if r[0] == rec and r[2] == f)
            pairs = [((t["x"] - d[3]) ** 2 + (t["y"] - d[4]) ** 2, j, k) for k, t in enumerate(active) for j, d in enumerate(det)]
            pairs = [p for p in pairs if p[0] <= radius ** 2]
            used = set()
            for j, k in choose(pairs, len(active), len(det), radius):
                d, t = det[j], active[k]
                t.update(x=d[3], y=d[4], last=f)
                t["ids"].append(d[1])
                used.add(j)
            for j, d in enumerate(det):
                if j not in used:
                    t = {"x": d[3], "y": d[4], "last": f, "ids": [d[1]]}
                    tracks.append(t)
                    active.append(t)
    return sorted(sorted(t["ids"]) for t in tracks)


def greedy(pairs, n, m, radius):
    uj, uk, out = set(), set(), []
    for _, j, k in sorted(pairs):
        if j not in uj and k not in uk:
            uj.add(j)
            uk.add(k)
            out.append((j, k))
    return out


@pytest.mark.parametrize("gap", [1, 3])
def test_nearest_neighbour_equals_frame_by_frame(spark, gap):
    rows = field(1)
    got = partition(L.link_nn(spark.createDataFrame(rows, LOC), 4.0, max_gap=gap).collect())
    assert got == online(rows, 4.0, gap, greedy)


def best_by_search(a, b, gain):
    edges = list(range(len(a)))
    top = 0.0
    for k in range(min(len(set(a)), len(set(b))) + 1):
        for pick in itertools.combinations(edges, k):
            if len({a[e] for e in pick}) == k == len({b[e] for e in pick}):
                top = max(top, sum(gain[e] for e in pick))
    return top


def test_assignment_is_optimal(spark):
    rng = np.random.default_rng(5)
    rows, want = [], 0.0
    for g in range(8):
        e = [(10 * g + i, 10 * g + j, float(rng.uniform(0.1, 4))) for i in range(4) for j in range(4) if rng.random() < 0.6]
        rows += e
        want += best_by_search([x[0] for x in e], [x[1] for x in e], [x[2] for x in e])
    df = spark.createDataFrame(rows, "a long, b long, gain double")
    got = df.join(L.assign(df), ["a", "b"]).collect()
    assert len({r.a for r in got}) == len(got) == len({r.b for r in got})
    assert abs(sum(r.gain for r in got) - want) < 1e-9


def test_subnet_with_memory_bridges_a_blink(spark):
    rows = [(0, f, f, float(f), 0.0, 1.0) for f in range(10) if f not in (4, 5)]
    df = spark.createDataFrame(rows, LOC)
    assert len(partition(L.link_subnet(df, 3.5, memory=0).collect())) == 2
    assert len(partition(L.link_subnet(df, 3.5, memory=2).collect())) == 1
    assert len(partition(L.link_lap(df, 3.5, 3).collect())) == 1
    assert len(partition(L.link_lap(df, 3.5, 2).collect())) == 2


def test_kalman_follows_a_fast_straight_track(spark):
    rows = [(0, f, f, 2.0 * f, 0.0, 1.0) for f in range(15)] + [(0, 100 + f, f, 2.0 * f, 30.0 - 2.0 * f, 1.0) for f in range(15)]
    got = partition(L.link_kalman(spark.createDataFrame(rows, LOC), 3.0, 2).collect())
    assert got == [list(range(15)), list(range(100, 115))]


def test_merge_event(spark):
    a = [(0, f, f, float(f), 0.0, 1.0) for f in range(10)]
    b = [(0, 100 + f, f, float(f), 3.0 - 0.5 * f, 1.0) for f in range(4)]
    df = spark.createDataFrame(a + b, LOC)
    linked, events = L.link_lap_full(df, 2.0, 1, merging=True)
    assert [r.kind for r in events.collect()] == ["merge"]
    assert len(partition(linked.collect())) == 1
    assert len(partition(L.link_lap(df, 2.0, 1).collect())) == 2


def test_dispatch_aliases_and_fallback(spark):
    df = spark.createDataFrame(field(2, 6, 6, rec=1), LOC)
    assert partition(L.link(df, "trackpy", 4.0, 0, 1).collect()) == partition(L.link_subnet(df, 4.0).collect())
    with pytest.warns(UserWarning, match="unknown linker"):
        L.link(df, "psychic", 4.0, 0, 1)
    assert max(map(len, partition(L.link(df, "nn", 4.0, 5, 1, max_len=2).collect()))) <= 2


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1201)} == {1000}


def brute_dbscan(xy, eps, k):
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= eps * eps
    core = d.sum(1) >= k
    label = np.full(len(xy), -1)
    c = 0
    for i in range(len(xy)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                j = todo.pop()
                for n in np.flatnonzero(d[j]):
                    if label[n] < 0:
                        label[n] = c
                        if core[n]:
                            todo.append(n)
            c += 1
    return core, label


def test_dbscan_with_crowded_cells(spark):
    """Half the points share two neighbouring cells, many of them coincident."""
    rng = np.random.default_rng(7)
    crowd = np.vstack([rng.normal(0, 0.02, (400, 2)), rng.normal((0.085, 0.0), 0.02, (400, 2)), np.tile([[0.05, 0.05]], (300, 1)),
                       rng.uniform(-1, 1, (300, 2))])
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(crowd)]
    out = U.dbscan(spark.createDataFrame(rows, "recording_id long, loc_id long, x double, y double"), 0.05, 6)
    got = {r.loc_id: r for r in out.collect()}
    core, label = brute_dbscan(crowd, 0.05, 6)
    assert [got[i].is_core for i in range(len(rows))] == core.tolist()
    assert [got[i].cluster for i in range(len(rows))] == label.tolist()


def test_touching_cells_refine_to_the_exact_gap(spark):
    """Two crowded cells whose nearest points are just apart, or just in reach."""
    for gap, want in ((0.0501, 0), (0.0499, 1)):
        rng = np.random.default_rng(1)
        a = np.column_stack([-rng.uniform(0, 0.01, 300), rng.uniform(0, 0.002, 300)])
        b = np.column_stack([gap + rng.uniform(0, 0.01, 300), rng.uniform(0, 0.002, 300)])
        a[0], b[0] = (0.0, 0.001), (gap, 0.001)
        rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([a, b]))]
        out = U.dbscan(spark.createDataFrame(rows, "recording_id long, loc_id long, x double, y double"), 0.05, 5)
        assert out.where("cluster >= 0").select("cluster").distinct().count() == 2 - want


def test_knn_with_coincident_points(spark):
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.uniform(0, 10, (60, 2)), np.tile([[3.0, 3.0]], (200, 1))])
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got = {r.loc_id: r.distance for r in P.knn_distance(
        spark.createDataFrame(rows, "recording_id long, loc_id long, x double, y double"), 3, crowd_factor=4).collect()}
    d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), 1)[:, 3]
    assert np.allclose([got[i] for i in range(len(rows))], d)


def test_hull_area(spark):
    rows = [(0, 0, float(x), float(y)) for x in range(5) for y in range(5)] + [(0, 1, 0.0, 0.0), (0, 1, 1.0, 1.0)]
    got = {r.cluster: r.area_um2 for r in U.hull_area(spark.createDataFrame(rows, "recording_id long, cluster long, x double, y double")).collect()}
    assert got == {0: 16.0, 1: None}


def test_suppression_equals_the_sequential_sweep(spark):
    rows = field(9, 4, 40, 15.0, 1)
    got = {r.loc_id for r in T.suppress_close(spark.createDataFrame(rows, LOC), 2.0).collect()}
    want = set()
    for f in range(4):
        kept = []
        for r in sorted((r for r in rows if r[2] == f), key=lambda r: (-r[5], r[3], r[4])):
            if all((r[3] - k[3]) ** 2 + (r[4] - k[4]) ** 2 > 4.0 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    assert got == want


def subnet(pairs, n, m, radius):
    """Least total cost by search, a track left alone costing radius²."""
    best, top = [], 0.0
    groups = {}

    def find(x):
        while groups.setdefault(x, x) != x:
            x = groups[x]
        return x
    for _, j, k in pairs:
        groups[find(("k", k))] = find(("j", j))
    out = []
    for root in {find(("k", k)) for _, _, k in pairs}:
        mine = [p for p in pairs if find(("k", p[2])) == root]
        best, top = [], 0.0
        for size in range(1, len(mine) + 1):
            for pick in itertools.combinations(mine, size):
                if len({p[1] for p in pick}) == size == len({p[2] for p in pick}):
                    gain = sum(radius ** 2 - p[0] for p in pick)
                    if gain > top:
                        top, best = gain, pick
        out += [(p[1], p[2]) for p in best]
    return out


@pytest.mark.parametrize("block", [2, 5, 64])
@pytest.mark.parametrize("rule,memory", [("greedy", 1), ("greedy", 3), ("best", 0), ("best", 3)])
def test_blocks_of_frames_equal_frame_by_frame(spark, rule, memory, block, monkeypatch):
    monkeypatch.setattr(L.match_in_blocks, "__defaults__", (block,))
    rows = field(7, frames=20, spots=8)
    df = spark.createDataFrame(rows, LOC)
    if rule == "greedy":
        assert partition(L.link_nn(df, 4.0, max_gap=memory).collect()) == online(rows, 4.0, memory, greedy)
    else:
        assert partition(L.link_subnet(df, 4.0, memory=memory).collect()) == online(rows, 4.0, memory + 1, subnet)


def test_sparse_assignment_equals_search():
    rng = np.random.default_rng(11)
    for _ in range(200):
        e = [(i, j, float(rng.choice([1.0, 2.0, rng.uniform(0.1, 4)]))) for i in range(5) for j in range(4) if rng.random() < 0.5]
        if not e:
            continue
        a, b, g = map(np.array, zip(*e))
        won = L._solve(a, b, g)
        assert len(set(a[won])) == won.sum() == len(set(b[won]))
        assert g[won].sum() == pytest.approx(best_by_search(a.tolist(), b.tolist(), g.tolist()))


def test_one_component_of_a_hundred_thousand_spots():
    """A chain of conflicts through all spots of two frames; the certificate is that prices and gains agree."""
    n, rng = 50_000, np.random.default_rng(3)
    x = np.arange(n) + rng.normal(0, 0.2, n)
    a = np.concatenate([np.arange(n), np.arange(n - 1), np.arange(1, n)])
    b = np.concatenate([np.arange(n), np.arange(1, n), np.arange(n - 1)])
    gain = 4.0 - (x[a] - (b + 0.3)) ** 2
    keep = gain > 0
    a, b, gain = a[keep], b[keep], gain[keep]
    won = L._solve(a, b, gain)
    assert len(np.unique(a[won])) == won.sum() == len(np.unique(b[won])) and won.sum() > 0.99 * n
    swapped = gain[won].sum()
    own = a == b
    assert swapped >= gain[own].sum()


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_at_every_density(spark, k):
    """Spots a million times denser than the rest, coincident points, lines and lone groups."""
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.uniform(0, 1000, (150, 2)), 500 + rng.normal(0, 1e-3, (400, 2)), 100 + rng.normal(0, 1e-9, (300, 2)),
                    np.column_stack([np.linspace(0, 1, 50), np.zeros(50)]), np.tile([[7.0, 7.0]], (9, 1))])
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(1, 10_000, 1.0, 1.0), (1, 10_001, 2.0, 1.0)] + [(2, 20_000 + i, 3.0, 3.0) for i in range(6)]
    df = spark.createDataFrame(rows, "recording_id long, loc_id long, x double, y double")
    got = {r.loc_id: r.distance for r in P.knn_distance(df, k).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    want = {i: float(np.sort(row)[k]) for i, row in enumerate(d)}
    if k == 1:
        want.update({10_000: 1.0, 10_001: 1.0})
    want.update({20_000 + i: 0.0 for i in range(6)})
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-18) for i in want)


def test_sweep_waits_for_blinking_tracks(spark):
    """Spots seen in every other frame have no tracks for consecutive frames, and their step as onset with memory 2."""
    rng = np.random.default_rng(6)
    rows = [(0, p * 100 + f, f, 60.0 * p + 2.0 * f, 5.0, 1.0) for p in range(4) for f in range(0, 40, 2)]
    df = spark.createDataFrame(rows, LOC)
    one, two = (L.estimate_search_range(df, memory=m).first() for m in (1, 2))
    assert one.onset_search_range is None and one.search_range == 5.0
    assert 4.0 <= two.onset_search_range < 6.0 and two.search_range == pytest.approx(min(1.1 * two.onset_search_range, two.cap_px))
    lenient = L.estimate_search_range(df, memory=2, sensitivity="lenient").first()
    assert lenient.search_range == pytest.approx(min(1.3 * two.onset_search_range, two.cap_px))
