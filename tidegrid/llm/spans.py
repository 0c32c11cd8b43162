"""What the two substring operators share: hashes of runs, the anchors of windows, and spans by document.

A window's anchor is the least hash among the short runs inside it, the leftmost one on a tie (Schleimer, Wilkerson
and Aiken, 2003; Roberts et al., 2004). It depends on the window's content alone, so equal windows have equal anchors, and
a window whose anchor occurs once in the corpus cannot repeat. That finds candidates without one row for every position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, sliding

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bits of a key that hold a position; texts go through in pieces shorter than that.
_PLACE = 24
PIECE = 1 << 22


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse mod 2**64, for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(1 << 16, 2 * n)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    return _powers[base]


class Runs:
    """Hashes of any run of codes in constant time, from their prefix sums. Codes must be well mixed."""

    def __init__(self, codes: np.ndarray, base: int = 0):
        self.up, self.down = _power(_BASES[base], len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the anchor) of each run of windows with one anchor.

    hashes: of the short runs; a window holds `width` of them.
    """
    low = np.uint64((1 << _PLACE) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding(key, width, np.minimum) & low).astype(np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return firsts, np.diff(firsts, append=len(place)), place[firsts]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as ordered ones that don't touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


#: Places of a key that go along with its row; more of them travel in rows of their own, of at most PACK places.
FEW, PACK = 8, 4096
PLACES = np.dtype([("row", "<i8"), ("place", "<i8")])


def packs(keys: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[list[bytes | None], list[tuple[int, int, bytes]]]:
    """For groups of places: the packed places behind the first of each (None: none, or too many), and rows
    (new key, old key, packed places) of those with too many. New keys spread a hot key's rows over all partitions."""
    more: list[bytes | None] = [None] * len(firsts)
    dealt = []
    for k in np.flatnonzero(sizes > 1).tolist():
        own = places[firsts[k] + 1 : firsts[k] + sizes[k]]
        if len(own) <= FEW:
            more[k] = own.tobytes()
            continue
        old = keys[firsts[k]]
        for a in range(0, len(own), PACK):
            some = own[a : a + PACK]
            seed = np.array([old, some["row"][0], some["place"][0]]).view(np.uint64)
            new = mix(mix(mix(seed[:1]) + seed[1:2]) + seed[2:])
            dealt.append((int(new.view(np.int64)[0]), int(old), some.tobytes()))
    return more, dealt


def unpacked(rows: DataFrame, *others: str) -> DataFrame:
    """(row, place, others): a row for each occurrence in rows(row, place, more, others); a null row has its places in more alone."""
    kinds = dict(rows.dtypes)

    def go(batches):
        for batch in batches:
            rest = [(i, np.frombuffer(m, PLACES)) for i, m in enumerate(batch.column("more").to_pylist()) if m is not None]
            known = np.flatnonzero(np.array(batch.column("row").is_valid()))
            own = np.concatenate([known, *(np.full(len(m), i) for i, m in rest)]).astype(np.int64)
            row = np.concatenate([np.array(batch.column("row").fill_null(0))[known], *(m["row"] for _, m in rest)])
            place = np.concatenate([np.array(batch.column("place"))[known], *(m["place"] for _, m in rest)])
            for a in range(0, len(own), 100_000):
                at = pa.array(own[a : a + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(row[a : a + 100_000]), pa.array(place[a : a + 100_000]), *(batch.column(c).take(at) for c in others)], ["row", "place", *others])

    fields = ", ".join(f"{c} {kinds[c]}" for c in others)
    return rows.select("row", "place", "more", *others).mapInArrow(go, f"row long, place long, {fields}")


def by_row(rows: DataFrame, *columns: str) -> DataFrame:
    """(row, one list for each column), the lists in one order. What a list holds is bounded by its text's length."""
    packed = rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("all"))
    return packed.select("row", *(F.col(f"all.{c}").alias(c) for c in columns))


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """texts(row, doc_id, ...), dealt by row, each with the lists at and to of spans(row, doc_id, at, to) (null: none).

    Two rows with one hash are told apart by their ids, which stay out of the join's keys, as texts are dealt by row alone.
    """
    found = spans.repartition("row").groupBy("row", "doc_id").agg(F.collect_list(F.struct("at", "to")).alias("all"))
    found = found.select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), F.col("all.at").alias("at"), F.col("all.to").alias("to"))
    same = (F.col("row") == F.col("_row")) & (F.col("doc_id") <= F.col("_id")) & (F.col("doc_id") >= F.col("_id"))
    return texts.join(found, same, "left").drop("_row", "_id")


def changes(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it; the first does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def lists(column: pa.Array, kind=np.int64) -> list[np.ndarray]:
    """Each row's list of numbers; a null list is empty."""
    offsets = np.array(column.offsets)
    values = np.array(column.values).astype(kind, copy=False)
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def doc_rows(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, row, c0, c1, ...), row a hash of id and text; columns that have their type already stay as they
    are, so that equal exchanges look equal."""
    kinds = {"doc_id": "bigint", "text": "string"}
    found = dict(docs.select(*kinds).dtypes)
    own = [F.col(c) if found[c] == k else F.col(c).cast(k).alias(c) for c, k in kinds.items()]
    found = docs.select(*own, *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
    return found.withColumn("row", F.xxhash64("doc_id", "text"))


def group_rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each group in it, size of each group) for equal values of h."""
    order = np.argsort(h, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
    return order, firsts, np.diff(firsts, append=len(h))

