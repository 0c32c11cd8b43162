"""Quality scores from a byte-level convolutional network, trained and run in numpy.

Channels of a byte: a learned embedding, and whether it equals the byte 2 to 17 places before. Learned filters eight
bytes wide move over them in steps of four. Chunks of 512 bytes, each half over the next, cover the whole document;
filters are max-pooled in each chunk, and the largest and the mean of the chunks' values make one probability.
The network reads nothing but the text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, remembered, small_batches, table

LAGS = range(2, 18)
BLOCK, HALF = 4, 256
#: Bytes that go through the network at once.
RUN_BYTES = 1 << 18
EMBED, FILTERS = 8, 24
#: The most labelled rows of each class that training takes (those with the least hashes).
SAMPLE_ROWS = {0: 1500, 1: 2500}
#: A text of more letters than WHOLE is learned from by EXCERPTS stretches of EXCERPT letters from anywhere in it, in turn.
WHOLE, EXCERPT, EXCERPTS = 32768, 8192, 8
#: Training takes 14 passes over the sample, more of a small one until there are this many steps.
LEAST_STEPS = 600


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        width = EMBED + len(LAGS)
        f = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f),
            "left": rng.normal(0, 0.12, (BLOCK * width, FILTERS)).astype(f),
            "right": rng.normal(0, 0.12, (BLOCK * width, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(f),
            "out_bias": np.zeros(1, f),
        }
        self.fixed: float | None = None  # a score for all, where there is nothing to learn from

    # Texts are laid end to end, each padded with zero bytes (at least one block) to whole halves.
    @staticmethod
    def lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and the number of halves of each text."""
        halves = np.array([len(t) // HALF + 1 if len(t) % HALF <= HALF - BLOCK else len(t) // HALF + 2 for t in texts], np.int64)
        raw = b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, halves.tolist()))
        return np.frombuffer(raw, np.uint8), halves

    def blocks(self, raw: np.ndarray, halves: np.ndarray) -> np.ndarray:
        same = np.zeros((len(LAGS), len(raw)), bool)
        for k, lag in enumerate(LAGS):
            np.equal(raw[lag:], raw[:-lag], out=same[k, lag:])
        same &= raw != 0
        starts = (np.cumsum(halves) - halves) * HALF
        for k, lag in enumerate(LAGS):
            same[k, (starts[:, None] + np.arange(lag)).ravel()] = False
        x = np.empty((len(raw), EMBED + len(LAGS)), np.float32)
        x[:, :EMBED] = self.p["embed"][raw]
        x[:, EMBED:] = np.ascontiguousarray(same.T)
        return x.reshape(len(raw) // BLOCK, -1)

    def pooled(self, raw: np.ndarray, halves: np.ndarray, places: bool = False):
        """Largest value of each filter in each half, with the block it stands at if asked for, and the blocks' channels."""
        x = self.blocks(raw, halves)
        made = x @ self.p["left"]
        made[:-1] += x[1:] @ self.p["right"]
        made += self.p["bias"]
        made[np.cumsum(halves) * (HALF // BLOCK) - 1] = -1e9  # would reach into the next text
        made = made.reshape(-1, HALF // BLOCK, FILTERS)
        if not places:
            return made.max(1), None, x
        at = made.argmax(1)
        return np.take_along_axis(made, at[:, None], 1)[:, 0], at + np.arange(len(made))[:, None] * (HALF // BLOCK), x

    @staticmethod
    def chunks(tops: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk the half that has the larger value, by filter, and each text's number of chunks."""
        firsts = np.cumsum(halves) - halves
        left = np.concatenate([np.arange(a, a + max(1, n - 1)) for a, n in zip(firsts.tolist(), halves.tolist())])
        ends = np.repeat(firsts + halves - 1, np.maximum(1, halves - 1))
        right = np.minimum(left + 1, ends)
        return np.where(tops[right] > tops[left], right[:, None], left[:, None]), np.maximum(1, halves - 1)

    def _combined(self, tops: np.ndarray, halves: np.ndarray):
        which, counts = self.chunks(tops, halves)
        value = np.maximum(np.take_along_axis(tops, which, 0), 0)
        firsts = np.cumsum(counts) - counts
        most, mean = np.maximum.reduceat(value, firsts), np.add.reduceat(value, firsts) / counts[:, None]
        logit = np.concatenate([most, mean], 1) @ self.p["out"] + self.p["out_bias"][0]
        return logit, which, value, counts, firsts, most, mean

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(texts), self.fixed)
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) + 2 * HALF <= RUN_BYTES):
                size += len(texts[to]) + 2 * HALF
                to += 1
            if len(texts[at]) > RUN_BYTES:
                tops = self._long(texts[at])
                halves, to = np.array([len(tops)]), at + 1
            else:
                raw, halves = self.lay(texts[at:to])
                tops = self.pooled(raw, halves)[0]
            out[at:to] = 1 / (1 + np.exp(-np.clip(self._combined(tops, halves)[0].astype(np.float64), -40, 40)))
            at = to
        return out

    def _long(self, text: bytes) -> np.ndarray:
        """Halves of a text too long for one run: pieces with the half before and the block behind them."""
        found, step = [], RUN_BYTES // HALF * HALF
        whole = len(text) // HALF + 1 if len(text) % HALF <= HALF - BLOCK else len(text) // HALF + 2
        for a in range(0, whole * HALF, step):
            before = min(a, HALF)
            raw, halves = self.lay([text[a - before : a + step + BLOCK]])
            tops = self.pooled(raw, halves)[0][before // HALF :]
            found.append(tops[: min(step // HALF, whole - a // HALF)])
        return np.concatenate(found)

    def train(self, texts: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.004, seed: int = 1) -> None:
        """texts: the stretches of each text; a pass takes one of them, the next pass the next."""
        rng, state, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        epochs = max(epochs, math.ceil(LEAST_STEPS / math.ceil(len(texts) / batch)))
        rounds = epochs * math.ceil(len(texts) / batch)
        for turn in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                step += 1
                now = rate * (0.5 + 0.5 * math.cos(math.pi * step / (rounds + 1)))
                for k, g in self._slopes([texts[j][turn % len(texts[j])] for j in some], labels[some], weights[some]).items():
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _slopes(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        raw, halves = self.lay(texts)
        tops, places, x = self.pooled(raw, halves, places=True)
        logit, which, value, counts, firsts, most, mean = self._combined(tops, halves)
        miss = (weights * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) / len(texts)).astype(np.float32)
        out = self.p["out"]
        grads = {"out": np.concatenate([most, mean], 1).T @ miss + 1e-4 * out, "out_bias": np.array([miss.sum()], np.float32)}
        # to chunks: the mean reaches all, the largest the first chunk that has it
        own = np.repeat(np.arange(len(texts)), counts)
        slope = (miss[:, None] * out[FILTERS:] / counts[:, None])[own]
        first = np.full((len(texts), FILTERS), len(value), np.int64)
        hit, col = np.nonzero(value == most[own])
        np.minimum.at(first, (own[hit], col), hit)
        np.add.at(slope, (first, np.arange(FILTERS)[None, :]), miss[:, None] * out[:FILTERS])
        slope *= value > 0
        on_half = np.zeros_like(tops)
        np.add.at(on_half, (which, np.broadcast_to(np.arange(FILTERS), which.shape)), slope)
        grads |= {"bias": on_half.sum(0), "left": np.zeros_like(self.p["left"]), "right": np.zeros_like(self.p["right"]), "embed": np.zeros_like(self.p["embed"])}
        half, f = np.nonzero(on_half)
        if not len(half):
            return grads
        order = np.argsort(f, kind="stable")
        half, f = half[order], f[order]
        g, at = on_half[half, f], places[half, f]
        firsts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        width = EMBED + len(LAGS)
        for name, shift in (("left", 0), ("right", 1)):
            place = np.minimum(at + shift, len(x) - 1)
            grads[name][:, f[firsts]] = np.add.reduceat(x[place] * g[:, None], firsts).T
            for k in range(BLOCK):
                by_filter = np.bincount(raw[place * BLOCK + k].astype(np.int64) * FILTERS + f, weights=g, minlength=256 * FILTERS).astype(np.float32)
                grads["embed"] += by_filter.reshape(256, FILTERS) @ self.p[name][k * width : k * width + EMBED].T
        return grads


def held_out() -> F.Column:
    """Rows that training never sees: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Network:
    """A network trained on a bounded sample of labelled rows that aren't held out (SAMPLE_ROWS of each class).

    Classes are weighted back to their share among all such rows. One class alone gives its smoothed share as the
    score of every text; no labels give 0.5. Null text: empty. Labels that are null or neither 0 nor 1 don't count. A
    document with both labels counts once for each, and so does each of rows that share a doc_id. Long texts are learned
    from in stretches (WHOLE), so that what reaches the driver is bounded.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out())
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    network = Network(seed)
    if len(share) < 2:
        network.fixed = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
        return network
    # which rows: from the labels alone, a bounded list of ids; then only those rows' texts are fetched
    hashed = known.dropDuplicates().withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    some = [r for mark, most in SAMPLE_ROWS.items() for r in hashed.where(F.col("quality") == mark).orderBy("h", "doc_id").limit(most).collect()]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in some], "id long, quality int")  # at most sum(SAMPLE_ROWS) rows
    found = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    length = F.length("text")
    places = [(F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(length - EXCERPT, F.lit(1))) + 1).cast("int") for i in range(EXCERPTS)]
    stretches = F.when(length <= WHOLE, F.array("text")).otherwise(F.array(*(F.substring("text", at, EXCERPT) for at in places)))
    rows = sorted((r["quality"], r["doc_id"], r["texts"]) for r in found.select("quality", "doc_id", stretches.alias("texts")).collect())
    texts, marks = [[t.encode() for t in r[2]] for r in rows], np.array([r[0] for r in rows], float)
    weights = np.where(marks == 1, share[1] / max(1, marks.sum()), share[0] / max(1, (1 - marks).sum()))
    if not len(texts):
        network.fixed = share[1] / sum(share.values())
        return network
    network.train(texts, marks, weights / weights.mean())
    return network


def score(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs(doc_id, text, ...).

    Null and empty text get the score of an empty document; null doc_ids stay and are not held out; repeated rows each
    get the same score; empty table: no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights

    def run(batches):
        remembered.clear()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(shared.value.scores(bytes_of(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    made = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, network: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        remembered.clear()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(bytes_of(batch.column("text"))) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
