"""Near-duplicate embeddings: Int8 tiles with rigorous error bounds, full precision only where they cannot decide.

Equal vectors are one vector with a number of copies.  A vector is scaled to length one and quantised to Int8 with a
scale of its own; ``e``, the exact length of what that loses, bounds the error of any product:
``|x.y - x'.y'| <= e_x + e_y + e_x e_y``.  Integer products of a tile are exact in float32 as long as
127^2 x dimensions < 2^24; longer vectors go by slices.  What the bound leaves open is computed in double precision.

Vectors are laid out in blocks by the pivot they are nearest to and by their angle from it.  By the triangle
inequality of angles some pairs of blocks cannot hold a near pair and are not looked at, and in some every pair is
near, which needs no products either; each other pair is a tile.  No pair leaves a tile: a tile says of each vector how
many others it is near to, and to which least one it is joined, so what comes out grows with the rows however many
pairs a hot group has.  The result is exact: no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._durable import checkpointed
from tabloom.llm.minhash import components

LEAST = 0.95
#: Vectors of a block, at most; pivots, at most.  Both only shape the plan.
BLOCK_ROWS, PIVOTS = 8192, 128
#: Ranges of the angle from a pivot, by whose counts blocks are laid out.
RANGES = 1024
_STRIP, _SLICE = 512, 1024
#: Far more than double precision loses in an angle.
_SLACK = 1e-6


def unit(flat: np.ndarray, d: int) -> np.ndarray:
    """Rows of length one, by way of their greatest part, so that no square overflows."""
    x = np.asarray(flat, np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales, and upper bounds of the length of the error, for unit vectors ``x`` in double precision."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error * (1 + 1e-9) + 1e-12


def tile_links(x: np.ndarray, y: np.ndarray, least: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, strip by strip, whose product is ``least`` or more, for unit rows; only i < j where both sides are the ``same``."""
    (qa, sa, ea), (qb, sb, eb) = quantised(x), quantised(y)
    worst, right = eb.max(initial=0.0), [qb[:, k : k + _SLICE].astype(np.float32).T.copy() for k in range(0, qb.shape[1], _SLICE)]
    scale = sb.astype(np.float32)
    for i in range(0, len(qa), _STRIP):
        first = i if same else 0
        left = qa[i : i + _STRIP]
        dots = left[:, :_SLICE].astype(np.float32) @ right[0][:, first:]
        for n, k in enumerate(range(_SLICE, qa.shape[1], _SLICE), 1):
            dots = dots.astype(np.float64) + left[:, k : k + _SLICE].astype(np.float32) @ right[n][:, first:]
        dots *= scale[first:]
        error = ea[i : i + _STRIP]
        # the exact integer times a rounded scale: 2^-22 covers both roundings
        floor = (least - (error + worst + error * worst) - 2.0**-20) / sa[i : i + _STRIP]
        a, b = np.nonzero(dots >= (floor - np.abs(floor) * 2.0**-22).astype(dots.dtype)[:, None])
        about, b = dots[a, b] * sa[a + i], b + first
        a += i
        if same:
            keep = a < b
            a, b, about = a[keep], b[keep], about[keep]
        bound = ea[a] + eb[b] + ea[a] * eb[b] + 2.0**-20
        sure = about - bound >= least
        open_ = np.flatnonzero((about + bound >= least) & ~sure)
        for k in range(0, len(open_), 1 << 14):
            some = open_[k : k + (1 << 14)]
            sure[some] = (x[a[some]] * y[b[some]]).sum(axis=1) >= least
        yield a[sure], b[sure]


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of ``a[i]`` and ``b[i]``; ``parent`` points every node at its component's least, before and after."""
    while True:
        p, q = parent[a], parent[b]
        apart = p != q
        if not apart.any():
            return
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def block_pairs(pivot: np.ndarray, low: np.ndarray, high: np.ndarray, between: np.ndarray, angle: float, a: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, blocks b >= it whose pairs need looking at, blocks b >= it all of whose pairs are near) for the blocks ``a``.

    ``low`` and ``high`` bound the angles of a block's vectors from its pivot, ``between`` has the pivots' angles.
    """
    for i in a.tolist():
        b = np.arange(i, len(pivot))
        g = between[pivot[i], pivot[b]]

        def gap(lo, hi, other_lo, other_hi, g=g):
            # between the angles from one pivot: its own block's, and what the other block's can be
            return np.maximum(lo - np.minimum(np.pi, g + other_hi), np.maximum.reduce([g - other_hi, other_lo - g, np.zeros(len(g))]) - hi)

        apart = np.maximum(gap(low[i], high[i], low[b], high[b]), gap(low[b], high[b], low[i], high[i])) > angle + _SLACK
        near = high[i] + g + high[b] <= angle - _SLACK
        yield i, b[~apart & ~near], b[near]


def _lists(values: pa.ListArray, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, their parts one after the other) of each length of the lists."""
    flat, at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    n = np.diff(at)
    rows = np.arange(len(n)) if rows is None else rows
    for d in np.unique(n[rows]):
        own = rows[n[rows] == d]
        yield int(d), own, flat[at[own][:, None] + np.arange(d)].reshape(-1)


def _nearest(centres: dict[int, np.ndarray], first: dict[int, int]):
    """For each batch: number of the nearest pivot of the same dimensions, and the angle from it."""

    def of(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        cell, turn = np.zeros(len(values), np.int32), np.full(len(values), np.pi)
        for d, rows, flat in _lists(values):
            if d in centres:
                dots = unit(flat, d) @ centres[d].T
                best = dots.argmax(axis=1)
                cell[rows], turn[rows] = first[d] + best, np.arccos(np.clip(dots[np.arange(len(rows)), best], -1, 1))
            else:
                cell[rows] = -d  # of dimensions that no pivot has: blocks without a known angle
        return cell, turn

    return of


def near_classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, class_id, links), a row for each vector: the least id of its class, and how many others it is near to.

    Two vectors are linked if their cosine is ``least`` or more; a class is what links hold together, and a vector
    without any is a class of its own.  Links of equal vectors count.  Null ids, null or empty vectors, vectors of length
    zero and vectors with a null, NaN or infinite part are left out; vectors of different dimensions are never near.
    Of rows that repeat an id the least vector counts.  Ids may be of any type that sorts.  Other columns are not looked
    at.  An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    real = df.schema[vector_col].dataType.simpleString()
    real = real if real in ("array<float>", "array<double>") else "array<double>"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(real).alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    # equal vectors are told by 128 bits of hash over all their parts: nothing is compared within a group
    rows = checkpointed(rows.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    groups = checkpointed(rows.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    vectors = rows.join(groups.select("id", "copies"), "id").select("id", "v", "copies")
    n = groups.count()
    wanted = max(1, min(pivots, -(-n // block_rows)))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # bounded by ``pivots``
    centres: dict[int, list] = {}
    for r in sample:
        centres.setdefault(len(r["v"]), []).append(r["v"])
    points = {d: unit(np.array(v).reshape(-1), d) for d, v in centres.items()}
    first, at = {}, 0
    for d, p in points.items():
        first[d], at = at, at + len(p)
    nearest = _nearest(points, first)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, turn = nearest(batch.column(1))
            part = np.minimum((turn / np.pi * RANGES).astype(np.int32), RANGES - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(part)], names=["id", "v", "copies", "cell", "part"])

    cells = checkpointed(vectors.mapInArrow(placed, f"id {kind}, v {real}, copies long, cell int, part int"))
    # ranges of a cell one after the other fill blocks; one that is too large for a block is dealt out by the ids' hashes
    layout, owner, low, high = [], [], [], []
    size = block_rows + 1
    for r in sorted(cells.groupBy("cell", "part").count().collect()):  # at most RANGES rows for each pivot
        cell, part, count = r
        deal = -(-count // block_rows)
        if deal == 1 and owner and owner[-1] == cell and size + count <= block_rows:
            size += count
            high[-1] = (part + 1) * np.pi / RANGES
        else:
            size = count if deal == 1 else block_rows + 1
            owner += [cell] * deal
            low += [part * np.pi / RANGES if cell >= 0 else 0.0] * deal
            high += [(part + 1) * np.pi / RANGES] * deal
        layout.append((cell, part, len(owner) - deal, deal))
    if not layout:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, class_id {kind}, links long")
    where = df.sparkSession.createDataFrame(layout, "cell int, part int, block int, deal int")
    blocks = cells.join(F.broadcast(where), ["cell", "part"]).select("id", "v", "copies", (F.col("block") + F.pmod(F.xxhash64("id"), F.col("deal"))).cast("int").alias("block"))
    # dimensions of each pivot set apart: blocks of different ones have no pair; those without a pivot have no known angle
    of_cell = {first[d] + i: (d, p) for d, ps in points.items() for i, p in enumerate(ps)}
    names = sorted(set(owner))
    index = np.array([names.index(c) for c in owner])
    between = np.full((len(names), len(names)), np.inf)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            da, db = of_cell.get(a, (-a, None)), of_cell.get(b, (-b, None))
            if i == j:
                between[i, j] = 0.0
            elif da[0] == db[0]:
                between[i, j] = float(np.arccos(np.clip(da[1] @ db[1], -1, 1)))
    lows, highs, angle = np.array(low), np.array(high), float(np.arccos(min(1.0, max(-1.0, least))))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i, look, near in block_pairs(index, lows, highs, between, angle, batch.column(0).to_numpy()):
                for b, all_near in ((look, False), (near, True)):
                    out.append((np.full(len(b), i, np.int32), b.astype(np.int32), np.full(len(b), all_near)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "near"])

    spark = df.sparkSession
    pairs = checkpointed(spark.range(len(owner)).mapInArrow(paired, "a int, b int, near boolean"))
    tiles = pairs.where("not near").select("a", "b")
    sides = tiles.select("a", "b", F.col("a").alias("block")).unionByName(tiles.where("a <> b").select("a", "b", F.col("b").alias("block")))
    out = "id {0}, root {0}, links long".format(kind)

    def linked(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("id", "ascending")])).combine_chunks()
        copies, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
        links, parent = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
        first, same = table.column("a")[0].as_py(), table.column("a")[0] == table.column("b")[0]
        values = table.column("v").chunk(0)
        left = {d: (r, unit(f, d)) for d, r, f in _lists(values, np.flatnonzero(block == first))}
        right = left if same else {d: (r, unit(f, d)) for d, r, f in _lists(values, np.flatnonzero(block != first))}
        for d, (rows_a, x) in left.items():
            if d not in right:
                continue
            rows_b, y = right[d]
            for i, j in tile_links(x, y, least, same):
                i, j = rows_a[i], rows_b[j]
                links += np.bincount(i, copies[j], len(links)).astype(np.int64) + np.bincount(j, copies[i], len(links)).astype(np.int64)
                merge(parent, i, j)
        hit = np.flatnonzero(links)
        ids = table.column("id")
        return pa.Table.from_arrays([ids.take(pa.array(hit)), ids.take(pa.array(parent[hit])), pa.array(links[hit])], names=["id", "root", "links"])

    seen = blocks.join(sides, "block").groupBy("a", "b").applyInArrow(linked, out)
    if not pairs.where("near").isEmpty():
        whole = checkpointed(blocks.groupBy("block").agg(F.sum("copies").alias("all"), F.min("id").alias("least")))
        near = pairs.where("near").select(F.col("a").alias("block"), F.col("b").alias("other")).unionByName(pairs.where("near and a <> b").select(F.col("b").alias("block"), F.col("a").alias("other")))
        near = near.join(whole.select(F.col("block").alias("other"), F.col("all").alias("theirs"), F.col("least").alias("their_least")), "other")
        near = near.groupBy("block").agg(F.sum("theirs").alias("theirs"), F.min("their_least").alias("root"), F.max((F.col("block") == F.col("other")).cast("long")).alias("own"))
        near = near.join(whole.select("block", "least"), "block")
        given = blocks.select("id", "copies", "block").join(near, "block").select("id", F.least("root", "least").alias("root"), (F.col("theirs") - F.col("own") * F.col("copies")).alias("links"))
        seen = seen.unionByName(given.where("links > 0 or root <> id"))
    seen = checkpointed(seen)
    joined = components(seen.select("id", F.col("root").alias("center")))
    counts = seen.groupBy("id").agg(F.sum("links").alias("links"))
    # every copy has its vector's class, its links, and the other copies
    known = groups.join(counts, "id", "left").join(joined, "id", "left").select("h", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return rows.select("id", "h").join(known, "h").select(F.col("id").alias("vec_id"), "class_id", "links")


def oracle(least: float = LEAST) -> str:
    """All products, and classes by walking the links from every vector."""
    return f"""
WITH RECURSIVE e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {least}),
w AS (SELECT DISTINCT x AS vec_id, x AS r FROM e UNION SELECT w.vec_id, e.y FROM w JOIN e ON w.r = e.x),
c AS (SELECT vec_id, min(r) AS class_id FROM w GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS links FROM e GROUP BY x)
SELECT v.vec_id, coalesce(c.class_id, v.vec_id) AS class_id, CAST(coalesce(n.links, 0) AS BIGINT) AS links
FROM embeddings v LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


ORACLE = oracle()
