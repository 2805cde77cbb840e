"""Near-duplicate vectors and centroid clusters against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyloom.llm import centroid_clusters, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "cls", "cell", "cluster", "v", "component", "links"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


def spread(rng, base, size):
    """A vector at about the given distance of a unit one."""
    e = rng.normal(size=len(base))
    return (base + e / np.linalg.norm(e) * size).astype(np.float32).tolist()


def planted(d=64, seed=3):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, 2):
        for g in range(14):
            base = rng.normal(size=d)
            base /= np.linalg.norm(base)
            for size in [0.0, 0.05, 0.12, 0.15, 0.19, 0.21, 0.3][: 1 + g % 7]:
                rows.append((n, spread(rng, base, size), label))
                n += 1
        rows += [(n + i, rows[-1][1], label) for i in range(9)]  # copies
        n += 9
    near = np.zeros(d)
    near[0] = 1
    rows += [(n + i, spread(rng, near, 0.1), 5) for i in range(60)]  # one large group of near copies
    n += 60
    odd = [None, [], [0.0] * d, [1.0] * (d - 1) + [float("nan")], [1.0] * (d - 1) + [float("inf")], [None] + [1.0] * (d - 1), [1.0] * (d - 2), [1e-38] * d, [3e38] * d, [-0.0] * (d - 1) + [1.0], [0.0] * (d - 1) + [1.0]]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)]
    n += len(odd)
    same = rows[0][1]
    return [*rows, (n, same, None), (n + 1, same, 4), (None, same, 0), (0, same, 0), (3, [2 * x for x in same], 0), (None, [0.5] * d, 9), (None, [0.5] * d, 9)]


def brute_groups(rows):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def unit(v):
        x = np.array(v, np.float32).astype(np.float64)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    n = len(rows)
    units = [unit(v) if fine(v) and label is not None else None for _, v, label in rows]
    of, links = list(range(n)), [0] * n

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                of[top(i)] = top(j)
    least = {}
    for i, (vec, *_) in enumerate(rows):
        if vec is not None:
            least[top(i)] = min(vec, least.get(top(i), vec))
    return sorted(((vec, links[i], least.get(top(i)), vec == least.get(top(i))) for i, (vec, *_) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block,cell", [(4096, 1024), (4096, 12), (7, 40), (16, 6)])
def test_groups(spark, block, cell):
    rows = planted()
    got = embedding_dedup.near_duplicates(vectors(spark, rows), reach=None, block=block, cell=cell).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows)


def test_groups_by_guests_of_bounded_reach(spark, tmp_path):
    rows = planted(seed=8)
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_groups(rows)
    for got in (embedding_dedup.query(spark, str(tmp_path)), embedding_dedup.near_duplicates(vectors(spark, rows), cell=16)):
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_recall_of_bounded_reach_and_bound_of_all():
    """No pair beyond the full margin is lost in any direction; with REACH at least 0.9 of pairs of random direction, measured."""
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.normal(size=(4000, 64)))
    noise = rng.normal(size=x.shape)
    noise -= np.einsum("ij,ij->i", noise, x)[:, None] * x
    y = embedding_dedup.unit(x + 0.2 * embedding_dedup.unit(noise))
    x, y = x[(x * y).sum(1) >= 0.98], y[(x * y).sum(1) >= 0.98]
    assert len(x) > 3000
    c = embedding_dedup.fit(x, 60)
    # the worst direction: across the border itself
    a = embedding_dedup.unit(c[:1] * 0.5 + c[1:2] * 0.5)
    w = embedding_dedup.unit(c[:1] - c[1:2])
    t = np.linspace(0.0, 0.1, 50)[:, None]
    across = [(embedding_dedup.unit(a + s * w), embedding_dedup.unit(a - (0.199 - s) * w)) for s in t]

    def found(u, v, reach):
        cells = lambda z: {(r, k): h for r, k, h in zip(*embedding_dedup.places(z, c, reach), strict=True)}
        p, q = cells(u), cells(v)
        return np.array([any(q.get((r, k)) is not None and (h or q[r, k]) for (s, k), h in p.items() if s == r) for r in range(len(u))])

    assert found(x[:800], y[:800], None).all()
    assert all(found(u, v, None).all() for u, v in across)
    assert found(x[:800], y[:800], embedding_dedup.REACH).mean() >= 0.99


def test_groups_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).collect() == []


def brute_clusters(rows, k=40, d=64, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for _, v in kept] if c else []

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    inertia = {}
    for s, j in at:
        inertia[j] = inertia.get(j, 0) + s
    return sorted(((i, j, s, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (s, j) in zip(kept, at, strict=True)), key=repr)


def clustered(seed, n, d=64):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)], 0) for i in range(n)]
    rows += [(n + i, [float(rng.choice([0, 1, 2, 3])) / 256 for _ in range(d)], None) for i in range(n // 3)]  # small whole numbers: many ties
    rows += [(n, rows[0][1], 1), (n, rows[1][1], 1), (3, rows[3][1], 1), (None, rows[2][1], 1)]
    odd = [None, [], [1.0] * (d - 1), [1.0] * (d - 1) + [float("nan")], [float("-inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1)]
    return rows + [(-i - 1, v, 1) for i, v in enumerate(odd)] + [(-99, [20_000.0 if i % 3 else -0.001 for i in range(d)], 2)]


@pytest.mark.parametrize("n", [5, 90, 400])
def test_clusters(spark, tmp_path, n):
    rows = clustered(n, n)
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroid_clusters.query(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows)


def test_clusters_of_odd_tables(spark):
    assert centroid_clusters.clusters(vectors(spark, [])).collect() == []
    assert centroid_clusters.clusters(vectors(spark, [(None, [1.0] * 64, 1)])).collect() == []
    with pytest.raises(Exception, match="too large for 64-bit distances"):
        centroid_clusters.clusters(vectors(spark, [(1, [1e9] * 64, 1)])).collect()


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(12, 64))[rng.integers(0, 12, 3000)] * 200 + rng.normal(size=(3000, 64)) * 40).astype(np.int64)
    old = v[:12].copy()
    cluster, upper, lower = centroid_clusters.rescan(v, old)
    for _ in range(6):
        new = np.array([v[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else old[j] for j in range(12)])
        cluster, upper, lower, scans = centroid_clusters.Moved(old, new).step(v, cluster, upper, lower)
        d2 = centroid_clusters.squares(v, new)
        assert (cluster == d2.argmin(1)).all()
        assert (upper >= np.sqrt(d2.min(1))).all() and (lower <= np.sort(np.sqrt(d2), 1)[:, 1]).all()
        old = new
    assert scans < 300
