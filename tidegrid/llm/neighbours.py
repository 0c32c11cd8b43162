"""Nearest neighbours by score-aware anisotropic quantisation (Guo et al., 2020).

Vectors are cut into small subspaces with 16 codewords each. Codebooks and codes are chosen by coordinate descent on a
loss that weighs the residual along the vector, which bends inner products, more than the rest. Every vector's codes
lie in the index, two four-bit codes to a byte; a scan adds up table entries for all of them, and the best of each
batch are ranked again by exact cosine. The scan streams: a task keeps a few rows for each query, never a batch's scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .vectors import dimension, matrix, sample, units

CODES = 16
#: Vectors that the codebooks are fitted to, at most.
SAMPLE = 8192
#: Queries that one scan broadcasts, about 10 MB; more queries take more scans.
QUERIES = 16384
#: Vectors that are scanned at once, and how many of them are ranked exactly for each query.
SCAN, RERANK = 2048, 96
#: Vectors in a part of the index, and the most parts; each gives k rows a query.
PART, MAX_PARTS = 8192, 1024
#: Inner products that matter are at least this share of the largest possible one (T of the paper).
THRESHOLD = 0.2


class Quantizer:
    def __init__(self, dim: int, threshold: float = THRESHOLD):
        self.dim, self.books = dim, []
        parts = max(1, dim // 2)
        parts += parts % 2
        self.parts = [p for p in np.array_split(np.arange(dim), parts)]
        # weight of the parallel error beyond that of the rest, less one
        self.extra = max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2) - 1)

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.books = []
        for part in self.parts:
            start = x[rng.choice(len(x), CODES, replace=len(x) < CODES)][:, part] if len(part) else np.zeros((CODES, 0))
            self.books.append(start.copy())
        for _ in range(rounds):
            codes, along = self._assign(x)
            for m, part in enumerate(self.parts):
                own, book = x[:, part], self.books[m]
                rest = along - ((own - book[codes[:, m]]) * own).sum(1)  # the parallel error of all other subspaces
                for c in range(CODES):
                    some = codes[:, m] == c
                    if not some.any() or not len(part):
                        continue
                    v = own[some]
                    left = len(v) * np.eye(len(part)) + self.extra * v.T @ v
                    right = v.sum(0) + self.extra * ((rest[some] + (v * v).sum(1))[:, None] * v).sum(0)
                    book[c] = np.linalg.solve(left, right)
                along = rest + ((own - book[codes[:, m]]) * own).sum(1)

    def _assign(self, x: np.ndarray, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and each vector's residual along itself. The first pass starts from the nearest codewords."""
        codes = np.zeros((len(x), len(self.parts)), np.uint8)
        along = np.zeros(len(x))
        for turn in range(passes + 1):
            for m, part in enumerate(self.parts):
                own, book = x[:, part], self.books[m]
                gap = own[:, None] - book[None]
                square, inner = (gap * gap).sum(2), (gap * own[:, None]).sum(2)
                if turn == 0:
                    codes[:, m] = square.argmin(1)
                else:
                    rest = along - np.take_along_axis(inner, codes[:, m : m + 1].astype(np.int64), 1)[:, 0]
                    codes[:, m] = (square + self.extra * (rest[:, None] + inner) ** 2).argmin(1)
                    along = rest
                along = along + np.take_along_axis(inner, codes[:, m : m + 1].astype(np.int64), 1)[:, 0]
        return codes, along

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, subspaces / 2) bytes; the even subspace is in the low four bits."""
        codes = self._assign(x)[0]
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(subspaces / 2, queries, 256): inner products of each query with both codewords of a byte."""
        low, high = np.arange(256) & 15, np.arange(256) >> 4
        single = [queries[:, part] @ book.T for part, book in zip(self.parts, self.books)]
        return np.stack([(a[:, low] + b[:, high]) for a, b in zip(single[0::2], single[1::2])]).astype(np.float32)


class _Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: slice, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[rows], score], 1), np.concatenate([self.ids[rows], ids], 1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.score.shape[1]]
        self.score[rows], self.ids[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _scan(queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, x: np.ndarray, ids: np.ndarray, quantizer: Quantizer, best: _Best, rerank: int, group: int = 128) -> None:
    for a in range(0, len(queries), group):
        q, q_ids = queries[a : a + group], query_ids[a : a + group]
        tables = quantizer.tables(q)
        total = np.zeros((len(q), len(ids)), np.float32)
        for m in range(tables.shape[0]):
            total += np.take(tables[m], codes[:, m], axis=1)
        total[q_ids[:, None] == ids[None]] = -np.inf
        top = np.argpartition(-total, rerank - 1, axis=1)[:, :rerank] if len(ids) > rerank else np.broadcast_to(np.arange(len(ids)), (len(q), len(ids)))
        score = np.einsum("qd,qrd->qr", q, x[top])
        own = ids[top]
        score[own == q_ids[:, None]] = -np.inf
        best.add(slice(a, a + group), score, own)


def _resized(batches, size: int):
    """The rows of the batches as tables of `size` rows, the last one of fewer."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        while n >= size:
            whole = pa.Table.from_batches(kept)
            yield whole.slice(0, size)
            rest = whole.slice(size)
            kept, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(kept)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = RERANK, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors(vec_id, embedding, ...) with the largest cosine to each
    row of queries(vec_id, embedding, ...), but rows with the query's own vec_id; nearest first, ties to the smaller vec_id.

    Vectors that are null, zero, of another length than most or that hold null or non-finite components take no part
    on either side, nor do rows with a null vec_id. Fewer than k candidates: all of them. Repeated rows count once. Of
    rows that share a vec_id with different vectors, each is a candidate, and the query is the one with the least bytes.
    Of equal vectors only the k + 1 least ids are candidates, which loses nothing. Vectors of any length are compared
    whole. Empty tables: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors, "embedding")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    as_long = F.col("vec_id").cast("long").alias("vec_id")
    if not dim:
        return empty
    found = units(vectors.select(as_long, "embedding").where("vec_id is not null"), dim, ["vec_id"])
    basis = sample(found, SAMPLE, dim)
    if not len(basis):
        return empty
    quantizer = Quantizer(dim)
    quantizer.fit(basis)

    def encode(batches):
        for batch in batches:
            codes = quantizer.encode(matrix(batch.column("unit").to_pylist(), dim)) if batch.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("unit"), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "unit", "codes"])

    least = Window.partitionBy("key").orderBy("vec_id")
    kept = found.where("key is not null").dropDuplicates(["vec_id", "key"]).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    # by the number of vectors, not of cores: a part gives k rows a query, whatever its size; every scan reads the files as they are
    parts = parts or max(1, min(MAX_PARTS, -(-found.count() // PART)))
    index = saved(kept.select("vec_id", "unit").repartition(parts).mapInArrow(encode, "vec_id long, unit binary, codes binary"), "index")

    asked = saved(units(queries.select(as_long, "embedding").where("vec_id is not null"), dim, ["vec_id"]).where("key is not null").groupBy("vec_id").agg(F.min("unit").alias("unit")), "queries")
    n_blocks = -(-asked.count() // QUERIES)
    found_all = None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").collect()  # about QUERIES rows
        if not rows:
            continue
        block = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), matrix([bytes(r["unit"]) for r in rows], dim)))

        def scan(batches, block=block):
            query_ids, q = block.value
            best = _Best(len(q), k)
            for part in _resized(batches, SCAN):  # whatever the session's batches are
                x = matrix(part.column("unit").to_pylist(), dim)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
                _scan(q, query_ids, codes, x, part.column("vec_id").to_numpy(), quantizer, best, rerank)
            for a in range(0, len(q), 2048):
                real = np.isfinite(best.score[a : a + 2048])
                at = np.nonzero(real)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[a + at[0]]), pa.array(best.ids[a : a + 2048][at]), pa.array(best.score[a : a + 2048][at])], ["query_id", "vec_id", "score"])

        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        own = index.mapInArrow(scan, "query_id long, vec_id long, score double")
        own = own.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        own = saved(own, "found") if n_blocks > 1 else own
        found_all = own if found_all is None else found_all.union(own)
    return empty if found_all is None else found_all


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
