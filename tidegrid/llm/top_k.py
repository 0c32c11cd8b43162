"""Exact search for the largest inner products of whole numbers by a three-phase uniform threshold (Cao and Wang, 2004).

Vectors are cut by dimension into lists, each a table of its own; a score is the sum of its local scores, one a list.
First every list gives its highest local scores, whose whole scores yield a cutoff that the answers reach. The cutoff is
shared out evenly over the lists, beyond what their mean vectors score, so that an answer reaches its share in some list:
every list then gives all entries that do. What is still missing of those whose sum can reach the cutoff is looked up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, used_up
from .vectors import dimension, whole, whole_matrix

LISTS = 2
#: Local scores that a list gives first, for each of the k wanted and one more.
HEADS = 4
#: Different query vectors that one search broadcasts, about 8 MB; more take more searches.
QUERIES = 16384
#: Vectors in a part of a list, and the most parts.
PART, MAX_PARTS = 8192, 1024
#: Queries that are scored against a batch at once.
GROUP = 128
_NONE = np.iinfo(np.int64).min
_ENTRY = "q int, key binary, s long"


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(len(q), len(x)) inner products of whole numbers, exact: in doubles where no sum can leave 53 bits."""
    if int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1] < 1 << 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "V16")


def _batch(q: np.ndarray, keys: np.ndarray, s: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), raw, pa.array(s, pa.int64()), *(pa.array(v, pa.int64()) for v in more.values())], ["q", "key", "s", *more])


class _Heads:
    """The highest local scores of each query so far, and whose they are."""

    def __init__(self, n: int, size: int):
        self.s, self.keys = np.full((n, size), _NONE), np.zeros((n, size), "V16")

    def add(self, at: slice, s: np.ndarray, keys: np.ndarray) -> None:
        size = self.s.shape[1]
        top = np.argpartition(s, s.shape[1] - size, axis=1)[:, -size:] if s.shape[1] > size else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        both, own = np.concatenate([self.s[at], np.take_along_axis(s, top, 1)], 1), np.concatenate([self.keys[at], keys[top]], 1)
        best = np.argsort(both, axis=1, kind="stable")[:, -size:]
        self.s[at], self.keys[at] = np.take_along_axis(both, best, 1), np.take_along_axis(own, best, 1)


class _Search:
    """One block of query vectors against the lists."""

    def __init__(self, lists: list[DataFrame], cuts: list[int], queries: np.ndarray, mean: np.ndarray, k: int, heads: int):
        self.lists, self.k, self.heads = lists, k, heads
        self.spans = list(zip(cuts, cuts[1:]))
        self.queries, self.mean = queries, mean
        self.spark = lists[0].sparkSession
        self.shared = self.spark.sparkContext.broadcast(queries)

    def _over(self, frames: list[DataFrame], run, kind: str) -> DataFrame:
        """run(list number, batches) over every frame, one for each list; rows are marked by the bit of their list."""
        out = None
        for g, rows in enumerate(frames):
            found = rows.mapInArrow(lambda batches, g=g: run(g, batches), kind).withColumn("bit", F.lit(1 << g).cast("long"))
            out = found if out is None else out.union(found)
        return out

    def highest(self) -> DataFrame:
        """(q, key, s, bit): the highest local scores of each list."""
        shared, spans, size = self.shared, self.spans, self.heads

        def run(g, batches):
            q, (a, b) = shared.value, spans[g]
            best = _Heads(len(q), size)
            for batch in batches:
                if batch.num_rows:
                    x, keys = whole_matrix(batch.column("part").to_pylist(), b - a), _keys(batch.column("key"))
                    for at in range(0, len(q), GROUP):
                        best.add(slice(at, at + GROUP), inner(q[at : at + GROUP, a:b], x), keys)
            for at in range(0, len(q), GROUP):
                i, j = np.nonzero(best.s[at : at + GROUP] != _NONE)
                yield _batch(at + i, best.keys[at + i, j], best.s[at + i, j])

        order = Window.partitionBy("q", "bit").orderBy(F.desc("s"), "key")
        return self._over(self.lists, run, _ENTRY).withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.heads).drop("n")

    def reaching(self, shares: np.ndarray) -> DataFrame:
        """(q, key, s, over, bit): all entries that reach their list's share, and by how much."""
        shared, spans = self.shared, self.spans

        def run(g, batches):
            q, (a, b) = shared.value, spans[g]
            for batch in batches:
                if batch.num_rows:
                    x, keys = whole_matrix(batch.column("part").to_pylist(), b - a), _keys(batch.column("key"))
                    for at in range(0, len(q), GROUP):
                        s, least = inner(q[at : at + GROUP, a:b], x), shares[at : at + GROUP, g]
                        i, j = np.nonzero(s >= least[:, None])
                        yield _batch(at + i, keys[j], s[i, j], over=s[i, j] - least[i])

        return self._over(self.lists, run, f"{_ENTRY}, over long")

    def whole_scores(self, known: DataFrame) -> DataFrame:
        """(q, key, s) of the pairs of known(q, key, s, mask): their sum s, and what lists outside the mask have for them."""
        shared, spans = self.shared, self.spans
        asked = [known.where(F.col("mask").bitwiseAND(1 << g) == 0).groupBy("key").agg(F.collect_list("q").alias("qs")).join(rows, "key") for g, rows in enumerate(self.lists)]

        def run(g, batches):
            q, (a, b) = shared.value, spans[g]
            for batch in batches:
                if batch.num_rows:
                    x, keys, wanted = whole_matrix(batch.column("part").to_pylist(), b - a), _keys(batch.column("key")), batch.column("qs")
                    of, row = np.array(wanted.flatten(), np.int64), np.repeat(np.arange(len(x)), np.array(wanted.value_lengths(), np.int64))
                    for at in range(0, len(of), 1 << 15):
                        i, j = of[at : at + (1 << 15)], row[at : at + (1 << 15)]
                        yield _batch(i, keys[j], (q[i, a:b] * x[j]).sum(1))

        found = self._over(asked, run, _ENTRY).select("q", "key", "s").union(known.select("q", "key", "s"))
        return found.groupBy("q", "key").agg(F.sum("s").alias("s"))

    def shares(self, first: DataFrame) -> np.ndarray:
        """(queries, lists): local scores that add up to the cutoff of each query, the last of the k best of first(q, key, s).

        A query with fewer than k has all its pairs in first; nothing reaches its shares.
        """
        last = first.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "key"))).where(F.col("n") == self.k).select("q", "s").collect()  # a row a query
        shares = np.full((len(self.queries), len(self.spans)), np.iinfo(np.int64).max)
        if last:
            at, cutoff = np.array([r["q"] for r in last]), np.array([r["s"] for r in last], np.int64)
            base = np.stack([self.queries[at, a:b] @ self.mean[a:b] for a, b in self.spans], 1)
            own = np.floor(base + ((cutoff - base.sum(1)) / len(self.spans))[:, None]).astype(np.int64)
            own[:, -1] = cutoff - own[:, :-1].sum(1)
            shares[at] = own
        return shares

    def run(self) -> DataFrame:
        """(q, key, s): the pairs among which the k best of each query are, ties included, with their whole scores."""
        def sums(rows: DataFrame) -> DataFrame:
            return rows.groupBy("q", "key").agg(F.sum("s").alias("s"), F.sum("bit").alias("mask"), *([F.sum("over").alias("over"), F.count("*").alias("n")] if "over" in rows.columns else []))

        heads = saved(sums(self.highest()), "heads")
        first = saved(self.whole_scores(heads), "first")
        entries = sums(self.reaching(self.shares(first)))
        # what a list has not given is at least 1 below its share, and the shares add up to the cutoff
        able = saved(entries.where(F.col("over") >= len(self.lists) - F.col("n")), "able")
        found = saved(first.union(self.whole_scores(able)).groupBy("q", "key").agg(F.max("s").alias("s")).withColumn("n", F.rank().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("n") <= self.k).drop("n"), "reached")
        for used in (heads, first, able):
            used_up(used)
        return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors(vec_id, embedding, ...) with the largest inner product to each
    row of queries(vec_id, embedding, ...), both as floor(scale * x), but rows with the query's own vec_id; highest first,
    ties to the smaller vec_id. Exact at any size.

    Vectors that are null, of another length than most, or that hold null or non-finite components take no part on either
    side, nor do rows with a null vec_id; zero vectors do. Components are clipped where a score could leave 61 bits (at 64
    dimensions beyond 740,000). Fewer than k candidates: all. Repeated rows count once. Of rows that share a vec_id with
    different vectors, each is a candidate, and the query is the one with the least bytes. Of equal vectors only the k + 1
    least ids are candidates, and equal queries are searched once, which loses nothing. Empty tables: no rows. Other
    columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors, "embedding")
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = math.isqrt((1 << 61) // dim)
    named = whole(vectors.where("vec_id is not null"), dim, scale, most).dropDuplicates(["vec_id", "key"])
    # one row a different vector; Spark cuts the ids of one before it shuffles them
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1).groupBy("key").agg(F.min("x").alias("x"), F.collect_list("vec_id").alias("ids"))
    # by the number of vectors, not of cores: a part gives its heads for every query, whatever its size
    parts = max(1, min(MAX_PARTS, -(-vectors.count() // PART)))
    kept = saved(named.repartition(parts), "vectors")
    cuts = np.linspace(0, dim, min(lists, dim) + 1).astype(int).tolist()
    tables = [saved(kept.select("key", F.expr(f"substring(x, {8 * a + 1}, {8 * (b - a)})").alias("part")), f"list{g}") for g, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def sums(batches):
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = whole_matrix(batch.column("x").to_pylist(), dim)
            total, n = total + x.sum(0, dtype=float), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["total", "n"])

    seen = kept.select("x").mapInArrow(sums, "total binary, n long").collect()  # a row a part
    mean = sum(np.frombuffer(r["total"], float) for r in seen) / max(1, sum(r["n"] for r in seen))

    asked = saved(whole(queries.where("vec_id is not null"), dim, scale, most).groupBy("vec_id").agg(F.min(F.struct("x", "key")).alias("own")).select("vec_id", "own.*"), "queries")
    different = asked.select("key", "x").distinct()
    blocks = -(-different.count() // QUERIES)
    answers = spark.createDataFrame([], "key binary, best array<struct<less: long, vec_id: long>>")
    for b in range(blocks):
        rows = different.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).orderBy("key").collect()  # about QUERIES rows
        if not rows:
            continue
        found = _Search(tables, cuts, whole_matrix([bytes(r["x"]) for r in rows], dim), mean, k + 1, HEADS * (k + 1)).run()
        of = spark.createDataFrame([(i, bytes(r["key"])) for i, r in enumerate(rows)], "q int, of binary")
        ids = found.join(kept.select("key", "ids"), "key").select("q", (-F.col("s")).alias("less"), F.explode("ids").alias("vec_id"))
        first = ids.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("less", "vec_id"))).where(F.col("n") <= k + 1)
        best = first.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("less", "vec_id"))).alias("best"))
        answers = answers.union(best.join(of, "q").select(F.col("of").alias("key"), "best"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k)
    placed = asked.select(F.col("vec_id").alias("id"), "key").join(answers, "key").select("id", F.posexplode(others).alias("at", "hit"))
    return placed.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


OP11_SQL = """
with good as (
  select distinct vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c::double))) = 0
), scored as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score
  from good q, good v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id
), placed as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored
)
select query_id, rank, vec_id, score from placed where rank <= 5
"""
