"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Two unit vectors with cosine c are sqrt(2 - 2c) apart, and if the bisector of two cells parts them, one of them lies
within half of that from it. So each vector also visits the other cells whose bisector is that near: every link is then
found in the home cell of one of its ends, and none is lost to the cells. Equal vectors enter once, with their number.
Cells larger than a block are cut into blocks, and each pair of blocks is a group of its own. A group gives a row or
two for each vector, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .components import components
from .vectors import dimension, matrix, sample, units

#: Vectors that the cells are fitted to, at most, and how many of them a cell should have at least.
SAMPLE, FITTED = 16384, 8
#: Vectors of one label that a cell should have at least.
CELL = 32
#: What moving a vector into a cell costs, in products of vector pairs.
MOVE = 200.0
BLOCK = 2048
#: Vectors placed at once, and rows of a batch that leave for their cells: one vector may visit many.
PLACED, SENT = 512, 4096


def fit_cells(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centres of spherical k-means."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(1))
        fine = size > 1e-9
        centres = np.where(fine[:, None], sums / np.where(fine, size, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _spans(centres: np.ndarray) -> np.ndarray:
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    np.fill_diagonal(apart, np.inf)
    return np.maximum(apart, 1e-12)


def near_cells(x: np.ndarray, centres: np.ndarray, spans: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each vector, whether it visits each cell)."""
    dots = x @ centres.T
    home = dots.argmax(1)
    visits = dots.max(1)[:, None] - dots <= reach * spans[home]
    visits[np.arange(len(x)), home] = False
    return home, visits


def placed_rows(batch: pa.RecordBatch, centres: np.ndarray, spans: np.ndarray, reach: float, dim: int):
    """Batches of SENT rows at most: each vector of batch(label, cls, copies, unit) with its home cell, and with each cell it visits."""
    names = ["label", "cls", "copies", "unit"]
    for start in range(0, batch.num_rows, PLACED):
        some = batch.slice(start, PLACED)
        x = matrix(some.column("unit").to_pylist(), dim)
        home, visits = near_cells(x, centres, spans, reach)
        row, cell = np.nonzero(visits)
        at, to = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell]).astype(np.int32)
        for k in range(0, len(at), SENT):
            rows = at[k : k + SENT]
            yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(rows)) for c in names), pa.array(to[k : k + SENT]), pa.array(home[rows].astype(np.int32))], [*names, "cell", "home"])


def choose_cells(x: np.ndarray, n: float, reach: float) -> np.ndarray:
    """Centres, fitted to the sample x, for n vectors a label: of 2, 4, 8 and so on that number whose work is least.

    More cells mean fewer pairs in each, but more visits to others; how many is measured on the sample.
    """
    best, least, k = fit_cells(x, min(2, len(x))), np.inf, 2
    while k <= max(2, min(n / CELL, len(x) / FITTED)) and k <= len(x):
        centres = fit_cells(x, k)
        visits = near_cells(x, centres, _spans(centres), reach)[1].sum(1).mean()
        cost = (1 + visits) * (MOVE + n / len(centres))
        if cost < least:
            best, least = centres, cost
        k *= 2
    return best


def _linked(a: np.ndarray, b: np.ndarray, threshold: float, skip=None):
    """Index pairs (rows of a, rows of b) with cosine at or over the threshold; skip(rows) masks pairs out."""
    left, right = [], []
    for i in range(0, len(a), 512):
        hit = a[i : i + 512] @ b.T >= threshold
        if skip is not None:
            hit &= ~skip(slice(i, i + 512))
        r, c = np.nonzero(hit)
        left.append(r + i)
        right.append(c)
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least index of each node's component, by minimum labels and pointer jumping."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        keep = label[u] != label[v]
        u, v = u[keep], v[keep]
    return label


def dedup(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors(vec_id, embedding, label, ...).

    Rows link if their labels are equal and their cosine, in double precision, is at least the threshold. n_links counts
    the other rows linked directly; component_id is the least vec_id reachable; kept marks it. Vectors that are null,
    zero, of another length than most or that hold null or non-finite components, and rows with a null label or null
    vec_id, link with nothing: 0 links, a component of their own (null without an id, and then not kept). Repeated rows
    link to each other. Rows that share a vec_id, with equal vectors or not, are vectors of their own: each has its own
    links, and component_id is still the least id. Vectors of any length are compared whole. Empty table: no rows. Other
    columns are ignored.
    """
    dim = dimension(vectors, "embedding")
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"]
    base = units(vectors.select(*columns), dim, ["vec_id", "label"]).withColumn("key", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("key")))
    taking = base.where("key is not null")
    classes = saved(taking.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    n, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()  # the number only guides the choice of cells
    if n:
        reach = float(np.sqrt(2 - 2 * threshold) / 2 + 1e-7)
        centres = choose_cells(sample(taking, SAMPLE, dim), n / max(1, labels), reach)
        counted = saved(_counts(classes, centres, dim, threshold, reach), "links")
        roots = components(counted.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")))
        links = counted.groupBy("cls").agg(F.sum("links").alias("links"))
        known = classes.select("label", "key", "rep", "cls", "copies").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
        known = known.join(least.hint("merge"), "root")
        known = saved(known.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "groups")
        joined = base.select("vec_id", "label", "key").join(known, ["label", "key"], "left")
    else:
        joined = base.select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _counts(classes: DataFrame, centres: np.ndarray, dim: int, threshold: float, reach: float) -> DataFrame:
    """(cls, links, root): rows that add up to each vector's links; (cls, root) rows span the components of a group."""
    shared = classes.sparkSession.sparkContext.broadcast((centres, _spans(centres)))  # at most SAMPLE / FITTED vectors

    def place(batches):
        cells, spans = shared.value
        for batch in batches:
            yield from placed_rows(batch, cells, spans, reach, dim)

    placed = classes.select("label", "cls", "copies", "unit").mapInArrow(place, "label string, cls long, copies long, unit binary, cell int, home int")
    placed = placed.withColumn("guest", F.col("cell") != F.col("home"))
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count_if(~F.col("guest")) / BLOCK).alias("homes"), F.ceil(F.count_if("guest") / BLOCK).alias("guests"))
    dealt = placed.join(sizes, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))))
    # a home block meets each home block once, itself too, and each guest block; (i, j): blocks of the two sides
    homes = F.sequence(F.lit(0).cast("long"), F.col("homes") - 1)
    guests = F.when(F.col("guests") > 0, F.sequence(F.lit(0).cast("long"), F.col("guests") - 1)).otherwise(F.array().cast("array<bigint>"))
    with_home = F.transform(homes, lambda j: F.struct(F.lit(False).alias("mixed"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    with_guest = F.transform(guests, lambda i: F.struct(F.lit(True).alias("mixed"), i.alias("i"), F.col("own").alias("j")))
    for_guest = F.when(F.col("homes") > 0, F.transform(homes, lambda j: F.struct(F.lit(True).alias("mixed"), F.col("own").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<mixed:boolean,i:bigint,j:bigint>>"))
    groups = F.when(F.col("guest"), for_guest).otherwise(F.concat(with_home, with_guest))
    rows = dealt.withColumn("g", F.explode(groups)).select("label", "cell", "home", "guest", "own", "cls", "copies", "unit", "g.mixed", "g.i", "g.j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, spans = shared.value
        mixed, i, j, cell = bool(pdf["mixed"].iat[0]), int(pdf["i"].iat[0]), int(pdf["j"].iat[0]), int(pdf["cell"].iat[0])
        x, cls, copies = matrix(pdf["unit"], dim), pdf["cls"].to_numpy(), pdf["copies"].to_numpy()
        own = pdf["own"].to_numpy()
        if mixed:
            guest = pdf["guest"].to_numpy()
            left, right = np.flatnonzero(guest), np.flatnonzero(~guest)
            # a home vector that visits the guest's home meets it there as well: counted in the smaller cell
            dots = x[right] @ cells.T
            also = (dots[:, cell][:, None] - dots <= reach * spans[cell]).T
            homes_of = pdf["home"].to_numpy()[left]
            also &= (np.arange(len(cells)) < cell)[:, None]
            u, v = _linked(x[left], x[right], threshold, lambda rows: also[homes_of[rows]])
        else:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            u, v = _linked(x[left], x[right], threshold)
            if i == j:
                once = u < v
                u, v = u[once], v[once]
        u, v = left[u], right[v]
        links = np.bincount(u, weights=copies[v], minlength=len(x)) + np.bincount(v, weights=copies[u], minlength=len(x))
        order = np.argsort(cls, kind="stable")
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        roots = cls[order][local_roots(len(x), place[u], place[v])][place]
        some = links > 0
        return pd.DataFrame({"cls": cls[some], "links": links[some].astype(np.int64), "root": roots[some]})

    return rows.groupBy("label", "cell", "mixed", "i", "j").applyInPandas(compare, "cls long, links long, root long")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
with recursive unit as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v,
         sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings
), links as (
  select a.vec_id as u, b.vec_id as v from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reach(id, seen) as (
  select vec_id, vec_id from embeddings union select r.id, l.v from reach r join links l on l.u = r.seen
), groups as (
  select id, min(seen) as component_id from reach group by id
), counts as (
  select u, count(*) as n from links group by u
)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, g.component_id, e.vec_id = g.component_id as kept
from embeddings e join groups g on g.id = e.vec_id left join counts c on c.u = e.vec_id
"""
