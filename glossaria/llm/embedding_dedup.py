"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells, one kept per group.

Vectors equal in every component are one class with a count. Centroids come from spherical k-means on
a bounded sample (`sample` vectors, a documented bound; they only steer the work, not the result).
Every class goes to its nearest centroid's cell, and as a guest to each lower-numbered cell that can
hold a partner: with x at home in c and y at home in c', cos(x, y) >= t needs y within asin(sqrt(1 - t^2)) of
the plane between the two centroids. So each pair meets in exactly one cell and none is lost.

A cell is split into blocks by hash and every pair of blocks is one task of at most about
2 x `block` rows and 128 MB of vectors, whatever the cell's size. So a vector is copied once for every `block` others that its
cell holds; blocks are large, and links are kept as bits in a task, to keep these copies few. A task emits, for a vector with links, their number and the
smallest vector of its component within the task: at most one row a vector, never the pairs.
Components over those rows are found by distributed star steps.

Cost: the number of products is quadratic within cells; where vectors have no cluster structure most
cells are guests of each other and it nears n^2 / 2, which exactness asks for in the worst case.

Defined cases: a vector that is null, empty, all zero or holds a null or non-finite component links with
nothing (n_links 0, own component, kept); vectors of different lengths never link; rows with
null vec_id link with nothing and keep a null component; a repeated row is a vector of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, release, small_batches, spread_join

#: Rows of a block that are multiplied with the other block at once.
_STEP = 256


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 2) -> np.ndarray:
    """k unit centroids of unit rows x; an empty cell takes the row that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        home = s.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        worst = s[np.arange(len(x)), home].argsort()[: len(empty)]
        new[empty] = x[worst]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-300), c)
    return c


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Vectors that are held against the centroids at once.
_ROWS = 1024


def _guests(s: np.ndarray, home: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells below a row's home that can hold a partner of it. s: products with the centroids.

    The distance of two centroids follows from their product; those of a cell are worked out when a row of it comes, one row of
    distances at a time, so memory is that of a block of rows and not of all pairs of centroids.
    """
    rows, cells = [], []
    for h in np.unique(home).tolist():
        if not h:
            continue  # no cell is below the first
        gap = np.sqrt(np.maximum(2 - 2 * (c[:h] @ c[h]), 0))
        mine = np.flatnonzero(home == h)
        r, g = np.nonzero(s[mine, h][:, None] - s[mine, :h] <= reach * gap + 1e-7)
        rows.append(mine[r])
        cells.append(g)
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (none, none)


def _cells(batches, centroids: dict, t: float):
    """(rep, mult, cell, guest, v): a row for the home cell and one for each cell that v is a guest of."""
    reach = np.sqrt(1 - t * t)
    for batch in batches:
        dims = np.diff(batch.column(2).offsets.to_numpy())
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x = _matrix(part.column(2), dim)
            c = centroids.get(dim)
            if c is None:
                rows, cell, guest = np.arange(len(x)), np.zeros(len(x), int), np.zeros(len(x), bool)
            else:
                s = x @ c.T
                home = s.argmax(axis=1)
                r, g = _guests(s, home, c, reach)
                rows, cell = np.concatenate([np.arange(len(x)), r]), np.concatenate([home, g])
                guest = np.concatenate([np.zeros(len(x), bool), np.ones(len(r), bool)])
            for i in range(0, len(rows), 8192):
                j = pa.array(rows[i : i + 8192])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(j), part.column(1).take(j), pa.array(np.full(len(j), dim, np.int32)), pa.array(cell[i : i + 8192].astype(np.int32)), pa.array(guest[i : i + 8192]), part.column(2).take(j)],
                    names=["rep", "mult", "dim", "cell", "guest", "v"],
                )


def _unit(table: pa.Table, t: float) -> pa.Table:
    """One task: the rows of its two blocks (side 0 and 1; a block with itself has side 0 only). Links are kept as bits."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    side = table.column("side").to_numpy()
    own = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    left = table.filter(pa.array(side == 0))
    right = left if own else table.filter(pa.array(side == 1))
    if not len(left) or not len(right):
        return empty
    dim = table.column("dim")[0].as_py()
    load = lambda q: (_matrix(q.column("v").combine_chunks(), dim), q.column("rep").to_numpy(), q.column("mult").to_numpy())
    x, a, ma = load(left)
    y, b, mb = (x, a, ma) if own else load(right)
    na, nb = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    bits = []  # (rows with a link, their links)
    for k in range(0, len(x), _STEP):
        hit = x[k : k + _STEP] @ y.T >= t
        if own:
            hit[np.arange(len(hit)), np.arange(k, k + len(hit))] = False
        rows = np.flatnonzero(hit.any(axis=1))
        if len(rows):
            hit = hit[rows]
            na[k + rows], nb = (hit * mb).sum(axis=1), nb + (hit * ma[k + rows][:, None]).sum(axis=0)
            bits.append((k + rows, np.packbits(hit, axis=1)))
    if not bits:
        return empty
    la, lb = a.copy(), b.copy()
    big = np.iinfo(np.int64).max
    while True:
        before = la.sum(), lb.sum()
        for rows, packed in bits:
            hit = np.unpackbits(packed, axis=1, count=len(y)).view(bool)
            la[rows] = np.minimum(la[rows], np.where(hit, lb, big).min(axis=1))
            lb = np.minimum(lb, np.where(hit, la[rows][:, None], big).min(axis=0))
        if own:
            la = lb = np.minimum(la, lb)
        if (la.sum(), lb.sum()) == before:
            break
    one = na > 0
    if own:
        return pa.table({"a": a[one], "b": la[one], "n": na[one]})
    two = nb > 0
    return pa.table({"a": np.concatenate([a[one], b[two]]), "b": np.concatenate([la[one], lb[two]]), "n": np.concatenate([na[one], nb[two]])})


class CosineGroups:
    def __init__(self, threshold: float = 0.95, sample: int = 32768, per_cell: int = 4096, max_cells: int = 1024, block: int = 16384):
        self.t, self.sample, self.per_cell, self.max_cells, self.block = threshold, sample, per_cell, max_cells, block

    def groups(self, vectors: DataFrame) -> DataFrame:
        """vec_id, n_links, component_id, kept for every row."""
        spark, t = vectors.sparkSession, self.t
        small_batches(spark, 8192)
        e = F.col("embedding")
        good = F.coalesce(
            (F.size(e) > 0)
            & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(e, lambda x: x != 0),
            F.lit(False),
        ) & F.col("vec_id").isNotNull()
        rows = vectors.select("vec_id", F.when(good, F.xxhash64(e)).alias("h1"), F.when(good, F.xxhash64(F.lit(7), e)).alias("h2"), F.when(good, e).alias("v"))
        full = durable(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v")), "emb-classes")
        counts = {x["d"]: x["n"] for x in full.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > self.per_cell).collect()}
        centroids = {}
        for dim, n in counts.items():
            k = min(self.max_cells, -(-n // self.per_cell))
            if k > 1:
                share = min(1.0, self.sample / n)
                pick = full.where((F.size("v") == dim) & (F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))))
                got = pick.select("rep", "v").orderBy("rep").toArrow()
                if len(got) > k:
                    centroids[dim] = spherical_kmeans(_matrix(got.column("v").combine_chunks(), dim), k)
        shape = f"rep long, mult long, dim int, cell int, guest boolean, v array<{vectors.schema['embedding'].dataType.elementType.simpleString()}>"
        per_task = F.greatest(F.lit(1), F.least(F.lit(self.block), F.floor(F.lit(8 << 20) / F.col("dim"))))
        shared = spark.sparkContext.broadcast(centroids)
        placed = durable(full.select("rep", "mult", "v").mapInArrow(lambda it: _cells(it, shared.value, t), shape), "emb-cells")
        shared.unpersist()
        size = placed.groupBy("dim", "cell").agg(F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("own"), F.sum(F.when(F.col("guest"), 1).otherwise(0)).alias("guests"))
        size = size.select("dim", "cell", F.ceil(F.col("own") / per_task).cast("int").alias("p"), F.ceil(F.col("guests") / per_task).cast("int").alias("g"))
        p = placed.join(size, ["dim", "cell"]).where("p > 0")
        blk = F.pmod(F.xxhash64(F.lit(5), "rep"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("p"))).cast("int")
        p = p.withColumn("k", blk)
        # Guests' blocks are numbered after the cell's own.
        units = F.expr(
            "case when guest then transform(sequence(0, p - 1), x -> struct(x as i, p + k as j, 1 as side)) "
            "else concat(transform(sequence(0, p - 1), x -> struct(least(x, k) as i, greatest(x, k) as j, if(k <= x, 0, 1) as side)), "
            "if(g > 0, transform(sequence(0, g - 1), x -> struct(k as i, p + x as j, 0 as side)), array())) end"
        )
        p = p.select("rep", "mult", "dim", "cell", "v", F.explode(units).alias("u")).select("rep", "mult", "dim", "cell", "v", "u.*")
        met = p.groupBy("dim", "cell", "i", "j").applyInArrow(lambda q: _unit(q, t), "a long, b long, n long")
        met = durable(met, "emb-met")
        release(placed)
        degree = met.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "rep")
        comp = components(met.select("a", "b")).withColumnRenamed("id", "rep")
        classes = durable(full.drop("v").join(degree, "rep", "left").join(comp, "rep", "left").withColumn("same", F.col("mult")), "emb-named")
        release(met, full)
        ids = rows.select("vec_id", "h1", "h2")
        bare = ids.where("h1 is null").select("vec_id", *[F.lit(None).cast("long").alias(c) for c in ("rep", "same", "links", "component")])
        out = spread_join(ids.where("h1 is not null"), classes, ["h1", "h2"], "mult").select(*bare.columns).unionByName(bare)
        component = F.coalesce("component", "rep", "vec_id")
        return out.select(
            "vec_id",
            F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.col("same") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        )
