"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector carries an upper bound of the distance to its centroid and a lower bound of that to the second nearest, from round
to round in a table of the shared folder. When centroids move, the upper bound grows by the drift of its own and the lower one
shrinks by the largest drift of the others. A vector whose upper bound stays below the lower one, or below half the distance
from its centroid to the next, keeps its centroid unseen; else the upper bound is made exact; and what is still ambiguous gets
the full scan of all centroids in exact integers, where ties fall to the smaller number. Bounds are rounded outwards
(SLACK), so they never decide what the exact scan would decide otherwise.

A round adds to the sums of the centroids only what moved: each task sends the integer sums and counts of vectors that came to
or left a centroid, at most two rows of numbers a centroid, whatever its vectors. The driver holds K centroids and their sums, nothing else.

Defined cases: vectors with another number of components than ``d``, none at all or a null or non-finite one are left out;
components from 2**27 / scale on would overflow the distances and fail with a message; rows that repeat a vec_id are vectors of
their own (ties of the choice of first centroids fall to the smaller components); rows without vec_id are clustered but start
no centroid; fewer than K vectors start fewer centroids, and without any that has an id all results are empty; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, read, tidy

K, D, SCALE, ROUNDS, SEED = 40, 64, 256, 5, 2
#: Components below this in absolute value keep squared distances of 64 components within 64 bits.
MOST = 1 << 27
#: Doubles compute sums of 64 such squares and products exactly.
EXACT = 1 << 22
SLACK = 1e-9
STATE = "vec_id {id}, v array<int>, cluster int, was int, upper double, lower double"


def quantised(vectors: DataFrame, d: int = D, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer components of each vector that is kept."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    fits = lambda y: F.when(F.abs(y) < MOST, y.cast("int")).otherwise(F.raise_error(F.lit("a component too large for 64-bit distances")).cast("int"))
    fine = vectors.where((F.size("embedding") == d) & F.forall("embedding", finite))
    return fine.select("vec_id", F.transform("embedding", lambda x: fits(F.floor(x.cast("double") * scale))).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k smallest digests, in their order (a top-k, k rows to the driver)."""
    named = kept.where("vec_id is not null").select("v", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256).alias("h"))
    return [list(r["v"]) for r in named.orderBy("h", "v").limit(k).collect()]


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    if not v.size or max(int(np.abs(v).max()), int(np.abs(c).max())) < EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for j, one in enumerate(c):
        diff = v - one
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


def own_squares(v: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    diff = v - c[cluster]
    return np.einsum("ij,ij->i", diff, diff)


def rescan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by a full scan."""
    d2 = squares(v, c)
    near = d2.argmin(1)
    at = np.arange(len(v))
    upper = np.sqrt(d2[at, near].astype(np.float64)) * (1 + SLACK)
    if len(c) == 1:
        return near, upper, np.full(len(v), np.inf)
    d2[at, near] = np.iinfo(np.int64).max
    return near, upper, np.sqrt(d2.min(1).astype(np.float64)) * (1 - SLACK)


class Moved:
    """What the bounds need to know of a step from old centroids to new ones."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.new = new
        self.drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        far = np.sort(self.drift)[::-1]
        second = far[1] if len(far) > 1 else 0.0
        self.others = np.where(np.arange(len(new)) == self.drift.argmax(), second, far[0])
        apart = np.sqrt(squares(new, new).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK)

    def step(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New (cluster, upper, lower) and the number of full scans."""
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[cluster], 0) * (1 - SLACK)
        bound = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= bound)
        upper[open_] = np.sqrt(own_squares(v[open_], self.new, cluster[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[upper[open_] >= bound[open_]]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = rescan(v[open_], self.new)
        return cluster, upper, lower, len(open_)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)


def _assigned(table: DataFrame, centroids: np.ndarray, old: np.ndarray | None, tag: str) -> DataFrame:
    """The state after assigning to the centroids: by full scans at first, by the bounds from then on."""
    schema = STATE.format(id=table.schema["vec_id"].dataType.simpleString())
    kind = arrow_schema(schema, table.sparkSession)
    moved = None if old is None else Moved(old, centroids)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch)
            if moved is None:
                was, (cluster, upper, lower) = np.full(len(v), -1), rescan(v, centroids)
            else:
                was = batch.column("cluster").to_numpy().astype(np.int64)
                cluster, upper, lower, _ = moved.step(v, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, kind, strict=True)], schema=kind)

    return materialize(table.mapInArrow(tidy(assign), schema), tag)


def _changes(state: DataFrame, k: int) -> list:
    """Rows (cluster, i, total): what components i of the sums, and counts (i = -1), change by; at most k * (d + 1) of them."""
    schema = "cluster int, i int, total long"
    kind = arrow_schema(schema, state.sparkSession)

    def sums(batches):
        total = None
        for batch in batches:
            v = _vectors(batch)
            if not len(v):
                continue
            v = np.concatenate([np.ones((len(v), 1), np.int64), v], 1)
            total = np.zeros((k, v.shape[1]), np.int64) if total is None else total
            for name, sign in (("cluster", 1), ("was", -1)):
                c = batch.column(name).to_numpy()
                for j in np.unique(c[c >= 0]):
                    total[j] += sign * v[c == j].sum(0)
        if total is not None:
            c, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((i - 1).astype(np.int32)), pa.array(total[c, i])], schema=kind)

    part = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(tidy(sums), schema)
    return part.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def clusters(vectors: DataFrame, k: int = K, d: int = D, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that is kept."""
    spark = vectors.sparkSession
    kept = materialize(quantised(vectors, d, scale), "vectors")
    now = np.array(first_centroids(kept, k, seed), np.int64).reshape(-1, d)
    k = len(now)
    if not k:
        return kept.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    sums, counts = [[0] * d for _ in range(k)], [0] * k
    state, old = kept, None
    for n in range(rounds):
        state = _assigned(state, now, old, f"clusters-{n}")
        for r in _changes(state, k):
            if r["i"] < 0:
                counts[r["cluster"]] += int(r["total"])
            else:
                sums[r["cluster"]][r["i"]] += int(r["total"])
        old, now = now, np.array([[s // counts[j] for s in sums[j]] if counts[j] else now[j].tolist() for j in range(k)], np.int64)
    state = _assigned(state, now, old, "clusters-last")
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    kind = arrow_schema(schema, spark)

    def measured(batches):
        for batch in batches:
            c = batch.column("cluster")
            d2 = own_squares(_vectors(batch), now, c.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(kind[0].type), c, pa.array(d2, pa.int64())], schema=kind)

    out = state.select("vec_id", "v", "cluster").mapInArrow(tidy(measured), schema)
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, now[j].tolist())).encode()).hexdigest()) for j, s in inertia.items()]
    about = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings"))


def _round_sql(n: int) -> str:
    near = f"""a{n} AS MATERIALIZED (SELECT r, c, x2 FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS x2 FROM v JOIN c{n} c ON v.i = c.i GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY r ORDER BY x2, c) = 1)"""
    new = f""",
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, c{n}.i, CASE WHEN m.k IS NULL THEN c{n}.x ELSE ((m.s - ((m.s % m.k) + m.k) % m.k) // m.k)::BIGINT END AS x FROM c{n}
  LEFT JOIN (SELECT a.c, v.i, sum(v.x)::BIGINT AS s, count(*) AS k FROM v JOIN a{n} a USING (r) GROUP BY 1, 2) m ON m.c = c{n}.c AND m.i = c{n}.i)"""
    return near + (new if n < ROUNDS else "")


ORACLE_SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {D} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {D}),
v AS MATERIALIZED (SELECT r, unnest(generate_series(1, {D})) AS i, floor({SCALE} * unnest(e)::DOUBLE)::BIGINT AS x FROM kept),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {K}),
c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN v USING (r)),
{''.join(_round_sql(n) + (',' + chr(10) if n < ROUNDS else '') for n in range(ROUNDS + 1))},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1)
SELECT vec_id, c::INT AS cluster, x2 AS distance, (sum(x2) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(x2) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN kept USING (r) JOIN h USING (c)"""
