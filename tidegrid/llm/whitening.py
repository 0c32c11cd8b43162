"""Whitening by principal components, the covariance in tiles.

Dimensions are cut into column blocks and rows into row blocks. A tile is a pair of column blocks: a join on the row block
brings both together, tasks add up the products of each tile, and Spark adds up what the tasks found. Only the assembled
matrix, dimensions squared, is on the driver, where it is eigendecomposed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import saved, table, used_up
from .vectors import dimension, whole, whole_matrix

#: Dimensions in a column block, doubles in a row block, tiles that a task adds up at once.
TILE, BLOCK, HELD = 32, 1 << 17, 64
#: A matrix of more dimensions is refused: 512 MB on the driver.
MOST = 8192
#: Eigenvalues under this share of the trace count as zero.
ZERO = 1e-12
#: The whole numbers: floor(SCALE * component) + SHIFT, of which the first part is clipped to LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40


def _doubles(raws, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.float64).reshape(-1, dim)


def sums(rows: DataFrame, dim: int, kind: type) -> tuple[int, np.ndarray]:
    """(rows, sums by dimension) of rows(x): binary, dim numbers of eight bytes each; whole numbers add up exactly."""

    def run(batches):
        n, total = 0, np.zeros(dim, object if kind is np.int64 else float)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), kind).reshape(-1, dim)
            n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) if kind is np.int64 else repr(float(t)) for t in total], pa.string())], ["at", "n", "total"])

    exact = "decimal(38,0)" if kind is np.int64 else "double"
    found = rows.select("x").mapInArrow(run, "at int, n long, total string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(exact)).alias("total")).orderBy("at").collect()  # a row a dimension
    return (found[0]["n"] if found else 0), np.array([int(r["total"]) if kind is np.int64 else r["total"] for r in found], object if kind is np.int64 else float)


def covariance(rows: DataFrame, dim: int, n: int, mean: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of n rows(x), binary doubles, about mean, which is taken off before anything is multiplied."""
    spark = rows.sparkSession
    ship(spark)
    cuts = [*range(0, dim, TILE), dim]
    height = max(1, BLOCK // dim)

    def cut(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = _doubles(batch.column("x").to_pylist(), dim) - mean
            for at in range(0, len(x), height):
                block = x[at : at + height]
                parts = [np.ascontiguousarray(block[:, a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([part << 40 | seq] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["rows", "block", "x"])
                seq += 1

    def multiply(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "x", "y"))):
                product = _doubles([a], cuts[i + 1] - cuts[i]).T @ _doubles([b], cuts[j + 1] - cuts[j])
                held[i, j] = held[i, j] + product if (i, j) in held else product
                if len(held) >= HELD:
                    yield tiles(held)
                    held.clear()
        yield tiles(held)

    def tiles(held):
        return pa.RecordBatch.from_arrays([pa.array([k[s] for k in held], pa.int32()) for s in (0, 1)] + [pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], ["i", "j", "tile"])

    blocks = saved(rows.select("x").mapInArrow(cut, "rows long, block int, x binary"), "blocks")
    left, right = blocks.select("rows", F.col("block").alias("i"), "x"), blocks.select("rows", F.col("block").alias("j"), F.col("x").alias("y"))
    found = left.join(right, "rows").where("i <= j").select("i", "j", "x", "y").mapInArrow(multiply, "i int, j int, tile array<double>")
    found = found.select("i", "j", F.posexplode("tile").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    found = found.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("tile")).select("i", "j", F.col("tile.v").alias("tile"))
    out = np.zeros((dim, dim))
    for r in found.toLocalIterator():  # TILE * TILE numbers at a time, dim * dim in all
        (a, b), (c, d) = (cuts[r["i"]], cuts[r["i"] + 1]), (cuts[r["j"]], cuts[r["j"] + 1])
        out[a:b, c:d] = np.reshape(r["tile"], (b - a, d - c))
        out[c:d, a:b] = out[a:b, c:d].T
    used_up(blocks)
    return out / n


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n * x - total)^2, exact; None where they leave a long."""
    base = total // n
    off, rest = x - base.astype(np.int64), (total - n * base).astype(np.int64)
    if x.shape[1] * (int(np.abs(off).max(initial=0)) * n + n) ** 2 < 1 << 63:
        return ((n * off - rest) ** 2).sum(1).tolist()
    whole = (((n * off.astype(object)) - rest.astype(object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in whole]


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row of vectors(vec_id, embedding, ...) and each
    principal component, numbered from 1 by falling variance, of the whole numbers x = floor(64 * c) + 1000000.

    Fitted to each different x once: there are n, with sums S. deviation: sum of (n * x - S)^2, exact, null where it leaves
    a long. whitened: x less its mean, along the component, over the component's spread. explained: share of the variance.
    identity_error: how far whitened is from unit covariance over the fitted vectors, the same for all rows.

    Left out: vectors that are null, of another length than most, or that hold null or non-finite entries. Entries beyond
    2^34 are clipped. A row with a null vec_id or a repeated one is a row like any other. Components without variance are
    left out, so vectors that are all alike, and empty tables, give no rows. More than 8192 dimensions are an error. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = dimension(vectors, "embedding")
    if dim > MOST:
        raise ValueError(f"a covariance of more than {MOST} dimensions does not fit the driver")
    if not dim:
        return spark.createDataFrame([], kind)
    rows = saved(whole(vectors, dim, SCALE, LIMIT).select("vec_id", "x"), "rows")
    fit = saved(rows.select("x").distinct(), "fit")
    n, total = sums(fit, dim, np.int64)  # of the numbers without SHIFT, which no difference depends on
    if not n:
        return spark.createDataFrame([], kind)
    base = total // n
    whole_base, rest = base.astype(np.int64), ((total - n * base) / n).astype(float)

    def centred(batches):
        for batch in batches:
            x = (whole_matrix(batch.column("x").to_pylist(), dim) - whole_base).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    matrix = covariance(fit.mapInArrow(centred, "x binary"), dim, n, rest)
    values, axes = np.linalg.eigh(matrix)
    trace = float(np.trace(matrix))
    kept = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > ZERO * trace]
    if not kept:
        return spark.createDataFrame([], kind)
    values, weights = values[kept], axes[:, kept] / np.sqrt(values[kept])

    def white(x: np.ndarray) -> np.ndarray:
        return ((x - whole_base).astype(float) - rest) @ weights

    def fitted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in white(whole_matrix(batch.column("x").to_pylist(), dim))], pa.binary())], ["x"])

    made = saved(fit.mapInArrow(fitted, "x binary"), "whitened")
    after = covariance(made, len(kept), n, sums(made, len(kept), float)[1] / n)
    error = float(np.abs(after - np.eye(len(kept))).max())
    explained, m = values / trace, len(kept)

    def run(batches):
        for batch in batches:
            x = whole_matrix(batch.column("x").to_pylist(), dim)
            deviation = _deviations(x, n, total)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * m, n)),
                    pa.array([d for d in deviation for _ in range(m)], pa.int64()),
                    pa.array(white(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * m, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    used_up(made)
    return rows.mapInArrow(run, kind)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
