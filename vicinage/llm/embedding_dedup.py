"""Embedding near-duplicates: vectors in principal-component order, compared tile by tile with early stopping.

Vectors are scaled to length one and turned to their principal components, so the leading dimensions hold most of every
product. A pair's cosine is at most the product of its leading dimensions plus the product of the two suffix norms; a
pair whose bound lies below the threshold is dropped, whole tiles before any vector is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import NULL_ID
from vicinage.llm.components import components
from vicinage.llm.source_mix import running_total
from vicinage.session import cut

THRESHOLD = 0.9
TILE = 4096                   # vectors of a tile: what a task holds twice
BLOCK = 1024
_SLACK = 1e-12                # rounding of a bound
_BOX = 6                      # leading dimensions in a tile's box and in the order of the vectors
_BITS = 8


def usable(v: Column) -> Column:
    """Not null, not empty, all components present and finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(partials: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices in `m`, added up on the executors to four at most."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], ["m"])

    rows = partials.mapInArrow(add, "m binary").repartition(4).mapInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r["m"]).reshape(shape) for r in rows), np.zeros(shape))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors (columns) of the second moment of all unit vectors in `v`, largest eigenvalue first."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column(0), width))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], ["m"])

    _, axes = np.linalg.eigh(_added(vectors.select("v").mapInArrow(moments, "m binary"), (width, width)))
    return np.ascontiguousarray(axes[:, ::-1])


def _order(y: np.ndarray) -> np.ndarray:
    """Leading coordinates with their bits interleaved: neighbours in space come near each other in the order."""
    q = np.clip((y[:, :_BOX] + 1) * (1 << (_BITS - 1)), 0, (1 << _BITS) - 1).astype(np.int64)
    code = np.zeros(len(y), dtype=np.int64)
    for bit in range(_BITS - 1, -1, -1):
        for d in range(q.shape[1]):
            code = (code << 1) | ((q[:, d] >> bit) & 1)
    return code


def linked(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, steps: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b (unit vectors in component order) with a product of at least the threshold."""
    lead = steps[0]
    with_bound = [np.hstack([m[:, :lead], np.sqrt((m[:, lead:] ** 2).sum(axis=1))[:, None]]) for m in (a, b)]
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            bound = with_bound[0][i:i + BLOCK] @ with_bound[1][j:j + BLOCK].T
            x, y = np.nonzero(bound >= threshold - _SLACK)
            x, y = x + i, y + j
            if same and i == j:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 16):
                yield from _finish(a, b, x[k:k + (1 << 16)], y[k:k + (1 << 16)], threshold, steps)


def _finish(a, b, x, y, threshold, steps):
    done, product = 0, np.zeros(len(x))
    for step in (*steps, a.shape[1]):
        product = product + np.einsum("ij,ij->i", a[x, done:step], b[y, done:step])
        if step < a.shape[1]:
            rest = np.sqrt((a[x, step:] ** 2).sum(axis=1) * (b[y, step:] ** 2).sum(axis=1))
            go = product + rest >= threshold - _SLACK
            x, y, product = x[go], y[go], product[go]
        done = step
    hit = product >= threshold
    if hit.any():
        yield x[hit], y[hit]


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n, by the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for x, y in pairs:
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return label


def tile_links(pairs: DataFrame, axes: np.ndarray, threshold: float, dtype: str) -> DataFrame:
    """(node, n, other): a vector's links within a pair of tiles, and the vector that stands for its group there.

    Links are counted, not listed: a group of any size gives one row per vector and pair of tiles.
    """
    width = axes.shape[0]
    steps = tuple(sorted({min(width, s) for s in (max(8, width // 4), max(16, width // 2))}))

    def turned(blob: bytes) -> np.ndarray:
        return unit(np.frombuffer(blob, dtype=dtype).reshape(-1, width)) @ axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in ("a", "b", "nodes_a", "nodes_b", "blob_a", "blob_b")}
                same = row["a"] == row["b"]
                nodes = np.frombuffer(row["nodes_a"], dtype=np.int64)
                a = turned(row["blob_a"])
                b = a if same else turned(row["blob_b"])
                shift = 0 if same else len(a)
                if not same:
                    nodes = np.concatenate([nodes, np.frombuffer(row["nodes_b"], dtype=np.int64)])
                found = [(x, y + shift) for x, y in linked(a, b, same, threshold, steps)]
                if found:
                    count = sum(np.bincount(z, minlength=len(nodes)) for p in found for z in p)
                    label, hit = _forest(len(nodes), found), np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[hit]), pa.array(count[hit].astype(np.int64)), pa.array(nodes[label[hit]])],
                        ["node", "n", "other"])

    return pairs.mapInArrow(run, "node long, n long, other long")


def _tile_pairs(boxes: DataFrame, reach: float) -> DataFrame:
    """Pairs of tiles, a <= b, whose boxes come within `reach`: an interval join on the first axis, then all axes."""
    cells = F.sequence(F.floor(F.col("low")[0] / reach), F.floor(F.col("high")[0] / reach))
    left = boxes.select(F.col("tile").alias("a"), F.col("low").alias("_low"), F.col("high").alias("_high"),
                        F.explode(F.sequence(F.floor(F.col("low")[0] / reach) - 1, F.floor(F.col("high")[0] / reach) + 1)).alias("_cell"))
    right = boxes.select(F.col("tile").alias("b"), F.col("low").alias("_low_b"), F.col("high").alias("_high_b"),
                         F.explode(cells).alias("_cell"))
    gaps = F.zip_with(F.zip_with("_low_b", "_high", lambda x, y: x - y), F.zip_with("_low", "_high_b", lambda x, y: x - y),
                      lambda x, y: F.greatest(F.lit(0.0), x, y))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= reach * reach + 1e-9
    return left.join(right, "_cell").where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def _within(rows: DataFrame, width: int, dtype: str, threshold: float, tile: int) -> DataFrame:
    """(node, id, n_links, root): linked vectors of one length. rows: (id, v)."""
    axes = principal_axes(rows, width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = unit(_matrix(batch.column(1), width)) @ axes
                box = np.zeros((len(y), _BOX))
                box[:, :min(width, _BOX)] = y[:, :_BOX]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(_order(y)), pa.array(list(box), type=pa.list_(pa.float64()))],
                    ["id", "v", "code", "lead"])

    kind = "float" if dtype == "f4" else "double"
    placed = rows.mapInArrow(place, f"id long, v array<{kind}>, code long, lead array<double>")
    placed = placed.withColumn("_tie", F.coalesce("id", F.lit(NULL_ID))).withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    placed = running_total(placed, ["_all"], ["code", "_tie"], "_one", "node")
    placed = cut(placed.select("node", "id", "v", "lead", F.floor(F.col("node") / tile).alias("tile")))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        lead = np.stack(part["lead"].to_numpy())
        return pd.DataFrame({"tile": [part["tile"].iloc[0]], "nodes": [part["node"].to_numpy(np.int64).tobytes()],
                             "blob": [np.stack(part["v"].to_numpy()).astype(dtype).tobytes()],
                             "low": [lead.min(axis=0)], "high": [lead.max(axis=0)]})

    tiles = cut(placed.groupBy("tile").applyInPandas(
        pack, "tile long, nodes binary, blob binary, low array<double>, high array<double>"))
    pairs = _tile_pairs(tiles.select("tile", "low", "high"), float(np.sqrt(max(0.0, 2 - 2 * threshold))) or 1e-6)
    a = tiles.select(F.col("tile").alias("a"), F.col("nodes").alias("nodes_a"), F.col("blob").alias("blob_a"))
    b = tiles.select(F.col("tile").alias("b"), F.col("nodes").alias("nodes_b"), F.col("blob").alias("blob_b"))
    loaded = pairs.join(a, "a").join(b, "b").repartition(F.col("a"), F.col("b"))
    found = cut(tile_links(loaded, axes, threshold, dtype))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    named = placed.select("node", "id").join(counts, "node").join(roots, "node")
    smallest = named.groupBy("component").agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("root"))
    named = named.join(smallest, "component").select("node", "n_links", "root")
    return placed.select("node", "id").join(named, "node", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root")


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """(id, n_links, component, kept) for every row: how many vectors have a cosine of at least `threshold` with it.

    component is the smallest id reachable by links. Vectors that are null, empty or zero, or hold null or non-finite
    components link with nothing; vectors of different lengths never link. Equal vectors and rows of equal ids are rows
    of their own. A null id counts as the smallest inside; its component reads null. The threshold is positive. Empty
    table: empty result. Other columns are not looked at.
    """
    dtype = "f4" if dict(vectors.dtypes)[vector] == "array<float>" else "f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vector).cast("array<float>" if dtype == "f4" else "array<double>").alias("v"))
    good = usable(F.col("v"))
    out = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    lengths = [r[0] for r in rows.where(good).select(F.size("v")).distinct().orderBy(F.size("v")).collect()]
    for width in lengths:
        out = out.unionByName(_within(rows.where(good & (F.size("v") == width)), width, dtype, threshold, tile))
    component = F.when(F.col("root").isNull(), F.col("id")).when(F.col("root") != NULL_ID, F.col("root"))
    return out.select("id", "n_links", component.alias("component"), component.eqNullSafe(F.col("id")).alias("kept"))
