"""Packing by the cutting-stock method of Gilmore and Gomory (1961).

Documents become whole sequences and one remainder each. The remainders' length histogram (a few hundred classes, at
any input size) goes to the driver, where a linear program over packing patterns is solved by column generation: a
revised simplex keeps the patterns in use, and a knapsack dynamic program prices new ones. Patterns are rounded down,
what they leave is packed by best fit, and documents take the slots of their class by rank. Ranks are counted within
salted parts of a class, so that a length which very many documents share is no single task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, saved, small_batches, table
from .tokens import encoder

LENGTH = 2048
#: Id after each document.
END_ID = 1
#: Width of a length class; a remainder takes at most STEP - 1 tokens less than its class.
STEP = 8


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, nth): full pieces of each document, then its remainder; nth numbers a task's."""

    def run(batches):
        words, end, nth = encoder(tokenizer), np.array([END_ID], "<u4"), 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), bytes_of(batch.column("text"))
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 2 << 20):
                    size += len(texts[to])
                    to += 1
                ids, counts = words.encode(texts[at:to])
                ids, first, rows = ids.astype("<u4"), 0, []
                for doc_id, n in zip(doc_ids[at:to], counts.tolist()):
                    own = np.concatenate([ids[first : first + n], end])
                    first += n
                    for start in range(0, n + 1, length):
                        piece = own[start : start + length]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), n + 1, nth))
                        nth += 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"])
                at = to

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long")


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best pattern (counts by class) of unlimited items within room. sizes: ascending."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    use = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := use[c]:
            worth = best[c - sizes[:n]] + values[:n]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], take[c] = worth[k], k
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[room]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4, max_rounds: int = 6000) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns with their fractional use, and a lower bound on the number of sequences.

    The least use of sequences that covers demand, to the relative gap between the program's value and Farley's bound.
    """
    m = len(sizes)
    columns, cost = np.diag(room // sizes).astype(float), np.ones(m)
    inverse, use = np.diag(1 / (room // sizes)), demand / (room // sizes)
    bound, best = float(sizes @ demand) / room, sizes / room  # prices that give the volume bound; they steady the pricing
    smooth = 0.9
    for _ in range(max_rounds):
        prices = cost @ inverse
        low = int(prices.argmin())
        if prices[low] < -1e-9:  # covering more than is asked for is free
            column, price = np.zeros(m), 0.0
            column[low] = -1
        else:
            column = None
            for weight in (smooth, 0.0):
                asked = weight * best + (1 - weight) * prices
                value, counts = _knapsack(sizes, asked, room)
                if float(asked @ demand) / max(value, 1.0) > bound:
                    bound, best = float(asked @ demand) / max(value, 1.0), asked / max(value, 1.0)
                if prices @ counts > 1 + 1e-9:
                    column, price = counts.astype(float), 1.0
                    break
            if column is None or cost @ use <= bound * (1 + gap):
                break
        move = inverse @ column
        up = move > 1e-10
        ratios = np.where(up, use / np.where(up, move, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        use = np.maximum(use - step * move, 0)
        use[out] = step
        inverse[out] /= move[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(move[others], inverse[out])
        columns[:, out], cost[out] = column, price
    return [(columns[:, i].astype(np.int64), float(use[i])) for i in range(m) if cost[i] and use[i] > 1e-9], bound


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: number} with whole multiplicities that together have a slot for each item of the histogram."""
    left = {c: n for c, n in histogram.items() if n}
    done: list[tuple[dict[int, int], int]] = [({c: 1}, n) for c, n in left.items() if c >= room]
    left = {c: n for c, n in left.items() if c < room}
    if left:
        sizes = np.array(sorted(left), np.int64)
        patterns, _ = solve_patterns(sizes, np.array([left[c] for c in sizes.tolist()], float), room)
        for counts, use in sorted(patterns, key=lambda p: -p[1]):
            own = {int(c): int(k) for c, k in zip(sizes, counts) if k}
            times = min([int(use + 1e-6)] + [left[c] // k for c, k in own.items()])
            if times > 0:
                done.append((own, times))
                for c, k in own.items():
                    left[c] -= k * times
    open_bins: list[list] = []  # [room left, {class: number}]; at most a few items for each pattern remain here
    for c in sorted((c for c in left if left[c]), reverse=True):
        for _ in range(left[c]):
            fits = [b for b in open_bins if b[0] >= c]
            best = min(fits, key=lambda b: b[0], default=None)
            if best is None:
                open_bins.append(best := [room, {}])
            best[0] -= c
            best[1][c] = best[1].get(c, 0) + 1
    return done + [(b[1], 1) for b in open_bins]


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of each document.

    docs(doc_id, text, ...): null or empty text has the end id alone; a null doc_id stays null; each of repeated rows
    is packed; very long texts become full pieces and one remainder; empty table: no rows; other columns are ignored.
    Within a sequence pieces stand by doc_id and start, without gaps.
    """
    spark = docs.sparkSession
    pieces = saved(cut_pieces(docs, tokenizer or default_tokenizer(), length).withColumn("cls", F.ceil(F.col("length") / step)), "pieces")
    histogram = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # at most length / step rows
    salts = max(16, sum(histogram.values()) // 500_000)
    rows, first, base = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, length // step):
        for c, k in pattern.items():
            rows.append((c, first[c], first[c] + k * times, base, times))
            first[c] += k * times
        base += times
    slots = F.broadcast(spark.createDataFrame(rows, "cls long, lo long, hi long, base long, times long"))  # a few thousand rows at any input size
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.when(F.col("doc_id").isNull(), F.col("nth"))), F.lit(salts)))
    before = Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("cls", "salt").agg(F.count("*").alias("n")).select("cls", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("cls", "salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(firsts, ["cls", "salt"]).withColumn("rank", F.col("first") + F.col("k")).drop("first", "k", "salt")
    dealt = ranked.join(slots, (ranked.cls == slots.cls) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = dealt.withColumn("sequence_id", F.col("base") + (F.col("rank") - F.col("lo")) % F.col("times"))
    earlier = Window.partitionBy("sequence_id").orderBy("doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
