"""Vectors as rows of bytes: reading, checking and normalising embeddings in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each vector can take part, the unit vectors of those that can), in double precision.

    Left out: null, of another length than dim, all zero, with null or non-finite components.
    """
    n, column = len(column), column.cast(pa.large_list(pa.float64()))
    sizes = np.array(column.value_lengths().fill_null(-1), np.int64)
    good = sizes == dim
    rows = np.zeros((n, dim))
    if good.any() and dim:
        flat = column.filter(pa.array(good)).flatten()
        rows[good] = np.array(flat.fill_null(float("nan"))).reshape(-1, dim)
    good &= np.isfinite(rows).all(1)
    rows = rows[good]
    top = np.abs(rows).max(1) if len(rows) else np.zeros(0)  # scaled first: squares must not overflow or vanish
    some = top > 0
    good[np.flatnonzero(good)[~some]] = False
    rows = rows[some] / top[some, None]
    return good, rows / np.sqrt((rows * rows).sum(1))[:, None]


def dimension(table: DataFrame, column: str) -> int:
    """The most frequent length of the vectors, the smaller one on a tie; 0 if there are none."""
    found = table.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def units(table: DataFrame, dim: int, others: list[str], column: str = "embedding") -> DataFrame:
    """others, then unit (binary, doubles) and key (binary digest of the direction); both null where a vector takes no part."""
    ship(table.sparkSession)
    kept = table.select(*others, column)

    def run(batches):
        for batch in batches:
            good, rows = unit_rows(batch.column(column), dim)
            rows = rows + 0.0  # no negative zeros
            raw = iter(r.tobytes() for r in rows)
            made = [next(raw) if g else None for g in good.tolist()]
            keys = [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(made, pa.binary()), pa.array(keys, pa.binary())], [*others, "unit", "key"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in others)
    return kept.mapInArrow(run, f"{fields}, unit binary, key binary")


def matrix(raws, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.float64).reshape(-1, dim)


def sample(found: DataFrame, most: int, dim: int) -> np.ndarray:
    """At most `most` different unit vectors, those with the least hashes: the same for the same rows."""
    rows = found.where("key is not null").select("unit", F.xxhash64("key").alias("h")).distinct().orderBy("h", "unit").limit(most).collect()
    return matrix([bytes(r["unit"]) for r in rows], dim)


def whole_rows(column: pa.Array, dim: int, scale: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each vector can take part, floor(scale * x) of those that can, as whole numbers from -most to most).

    Left out: null, of another length than dim, with null or non-finite components. Zero vectors stay.
    """
    column = column.cast(pa.large_list(pa.float64()))
    good = np.array(column.value_lengths().fill_null(-1), np.int64) == dim
    rows = np.array(column.filter(pa.array(good)).flatten().fill_null(float("nan")), float).reshape(-1, dim) if good.any() else np.zeros((0, dim))
    finite = np.isfinite(rows).all(1)
    good[np.flatnonzero(good)[~finite]] = False
    with np.errstate(over="ignore"):
        return good, np.clip(np.floor(rows[finite] * scale), -float(most), float(most)).astype(np.int64)


def whole(table: DataFrame, dim: int, scale: int, most: int, column: str = "embedding") -> DataFrame:
    """(vec_id, x, key) of the vectors that whole_rows() keeps: x their numbers in binary, eight bytes each, key a digest of x."""
    ship(table.sparkSession)

    def run(batches):
        for batch in batches:
            good, rows = whole_rows(batch.column("embedding"), dim, scale, most)
            made = [r.tobytes() for r in rows]
            keys = [hashlib.blake2b(b, digest_size=16).digest() for b in made]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array(made, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "x", "key"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("embedding")).mapInArrow(run, "vec_id long, x binary, key binary")


def whole_matrix(raws, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.int64).reshape(-1, dim)
