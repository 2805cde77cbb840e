"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one class, which stands for all its copies from here on. Spherical k-means, fitted on a bounded
sample, gives every class a home cell, its nearest centroid. A class close to the border of a cell of smaller number is a guest
there: with unit normal w of the plane between the two centroids, a partner beyond the border has w.u >= 0 >= w.v, and both
lie w.(u - v) apart at most. As |u - v| <= sqrt(2 - 2 * 0.98) = 0.2, a guest from 0.199 on (the sine of the angle) can
have no partner, whatever the vectors; for spread of no preferred direction w.(u - v) has a deviation of |u - v| / sqrt(d),
so guests reach REACH of these and no further than 0.199. ``reach=None`` takes the whole 0.199: then no link can be missed.

Members of a cell are compared under one label: homes with homes, and with guests, block by block (BLOCK members each, dealt by
digest), as matrix products in double precision. A tile of two blocks sends on sums of links and a spanning forest, one row a
member at most, never its pairs. Connected components of the forests give the groups; the smallest id of each is kept.

Defined cases: a vector that is null, empty or zero, holds a null or non-finite component, or has no label, links with nothing, and so
do vectors of different lengths; rows without vec_id count as vectors but never name a component (a component of such rows only
has the id null, and keeps all of them); rows that repeat a vec_id are vectors of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, read, small_join, tidy
from .jaccard_join import components

COSINE = 0.98
#: Members of a block; a tile holds two.
BLOCK = 4096
#: Vectors a cell is meant for, and the most cells; beyond that cells grow, and get more blocks.
CELL, MAX_CELLS = 1024, 1024
#: Vectors that the centroids are fitted on (those of smallest digest, so the choice is the same in every run).
SAMPLE = 16_384
ROUNDS = 8
#: Deviations of w.(u - v) that guests reach.
REACH = 4.0


def usable(label: Column, v: Column) -> Column:
    """Whether a row can link with others at all."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(label.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means, begun with the first k."""
    c = sample[:k].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        length = np.sqrt(np.einsum("ij,ij->i", total, total))
        c = np.where(length[:, None] > 1e-12, total / np.maximum(length, 1e-12)[:, None], c)
    return c


def margin(d: int, reach: float | None) -> float:
    most = math.sqrt(1 - COSINE * COSINE)
    return most + 1e-9 if reach is None else min(most + 1e-9, reach * math.sqrt(2 - 2 * COSINE) / math.sqrt(d))


def places(x: np.ndarray, c: np.ndarray, reach: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether at home) of unit vectors: every row at home once, and as a guest in cells of smaller number."""
    near = x @ c.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    beyond = near[np.arange(len(x)), home][:, None] - near
    guest = (beyond <= margin(x.shape[1], reach) * apart[home]) & (np.arange(len(c)) < home[:, None])
    row, cell = np.nonzero(guest)
    return np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell]), np.arange(len(x) + len(row)) < len(x)


def _placed(classes: DataFrame, centroids: dict[int, np.ndarray], reach: float | None) -> DataFrame:
    """A row for each class and cell: d, label, cell, cls, n, home, unit (its components as doubles)."""
    schema = f"d int, label {classes.schema['label'].dataType.simpleString()}, cell int, cls long, n long, home boolean, unit binary"
    kind = arrow_schema(schema, classes.sparkSession)

    def place(batches):
        for batch in batches:
            v = batch.column("embedding")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                for i in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[i : i + 2048]))
                    x = unit(part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
                    row, cell, home = places(x, centroids[d], reach) if d in centroids else (np.arange(len(x)), np.zeros(len(x), int), np.ones(len(x), bool))
                    data = [y.tobytes() for y in x]
                    take = pa.array(row)
                    columns = [pa.array(np.full(len(row), d, np.int32)), part.column("label").take(take), pa.array(cell.astype(np.int32)), part.column("cls").take(take), part.column("n").take(take), pa.array(home), pa.array([data[r] for r in row], pa.binary())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return classes.select("cls", "n", "label", "embedding").mapInArrow(tidy(place), schema)


class Forest:
    """Groups of the members of a tile, as the links come in."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, members: np.ndarray) -> None:
        groups = np.unique(self.of[members])
        if len(groups) > 1:
            self.of[np.isin(self.of, groups)] = groups[0]


def tile_links(x: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(copies linked to each member, group of each member) over the pairs of first with second that a home is part of.

    first and second are the members of two blocks, or both all members of one.
    """
    links, forest = np.zeros(len(x), np.int64), Forest(len(x))
    same = first is second
    sides = [(first[home[first]], second), (first[~home[first]], second[home[second]])]
    for a, b in sides[: 1 if same else 2]:
        for i in range(0, len(a), 512):
            rows = a[i : i + 512]
            hit = x[rows] @ x[b].T >= COSINE
            hit &= rows[:, None] != b[None, :]
            if not hit.any():
                continue
            links[rows] += hit @ n[b]
            # within a block two homes meet twice, once as a row each
            other = b[~home[b]] if same else b
            links[other] += n[rows] @ (hit[:, ~home[b]] if same else hit)
            for r in np.flatnonzero(hit.any(1)):
                forest.link(np.append(b[hit[r]], rows[r]))
    return links, forest.of


def _tiled(table: pa.Table) -> pa.Table:
    """Of one tile: (a, null, copies linked to a) and (a, b, null) for a forest of its links."""
    d = table.column("d")[0].as_py()
    x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(-1, d)
    cls, n, home, block = (table.column(c).to_numpy() for c in ("cls", "n", "home", "block"))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    first = np.flatnonzero(block == lo)
    links, group = tile_links(x, n, first, first if lo == hi else np.flatnonzero(block == hi), home.astype(bool))
    linked, joined = np.flatnonzero(links), np.flatnonzero(group != np.arange(len(x)))
    a = np.concatenate([cls[linked], cls[joined]])
    b = pa.array(np.concatenate([np.zeros(len(linked), np.int64), cls[group[joined]]]), pa.int64(), mask=np.arange(len(a)) < len(linked))
    w = pa.array(np.concatenate([links[linked], np.zeros(len(joined), np.int64)]), pa.int64(), mask=np.arange(len(a)) >= len(linked))
    return pa.table({"a": pa.array(a, pa.int64()), "b": b, "w": w})


def near_duplicates(vectors: DataFrame, reach: float | None = REACH, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", "embedding")
    fine = rows.where(usable(F.col("label"), F.col("embedding")))
    classes = fine.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    sizes = {r["d"]: r["c"] for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(64).collect()}
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding", "label"), "cls").limit(SAMPLE).toArrow().column("embedding").to_pylist()
    centroids = {}
    for d, count in sizes.items():
        x = [v for v in sample if len(v) == d]
        k = min(MAX_CELLS, -(-count // cell), len(x) // 8)
        if k > 1:  # lengths that are rare, or not in the sample, have one cell, in as many blocks as it takes
            centroids[d] = fit(unit(np.array(x, np.float64)), k)
    placed = materialize(_placed(classes, centroids, reach), "vector-cells")
    key = ["d", "label", "cell"]
    many = materialize(placed.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > block).select(*key, F.ceil(F.col("c") / block).cast("int").alias("blocks")), "vector-blocks")
    dealt = small_join(placed, many, key, "left", 64).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "cls", "n", "home", "unit")
    found = materialize(dealt.groupBy(*key, "lo", "hi").applyInArrow(_tiled, "a long, b long, w long"), "vector-links")

    links = found.where("w is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("links"))
    named = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    about = materialize(links.join(named, "cls", "left"), "vector-groups")
    linked = small_join(classes, about, ["cls"], "left", 64).where("n > 1 or links is not null")
    linked = materialize(linked.select("label", "embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component")), "vector-linked")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    known = linked.join(names, "component").select("label", "embedding", (F.col("links") + F.col("n") - 1).alias("links"), "component_id", F.lit(True).alias("known"))
    held = linked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 96), F.lit(0))).first()[0]
    out = small_join(rows, materialize(known, "vector-known"), ["label", "embedding"], "left", 1, held)
    name = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, COALESCE(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN named USING (r) LEFT JOIN degree USING (r)"""
