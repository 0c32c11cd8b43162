"""Repeated word spans by compaction of a de Bruijn graph.

Edges are k-mers of words, from the vertex of a k-mer's first k - 1 words to that of its last. Of the edges those are
kept that anchor some 50-word window (see spans.py), which loses no repeat; the words from the start of one kept edge to
the end of the document's next, or from or to the end of a document, spell the walk of other edges between them. Only
edges that occur in two or more documents stay. Where every occurrence of an edge goes on by one walk, and every
occurrence of the edge behind it comes by that walk, no vertex between them branches: the two are linked, and Spark joins
compact linked edges into nonbranching paths by pointer jumping. The paths' source coordinates then verify what repeats:
128-bit hashes of the words that stand there, whole paths at once and the windows over a path's ends one by one, are
compared between documents, and only spans whose words are equal go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, remembered, saved, small_batches, table, used_up
from .spans import PIECE, PLACES, Runs, anchors, by_row, changes, doc_rows, group_rows, lists, merged, packs, unpacked, with_spans

WIDTH, K = 50, 15
_GATHER = 1 << 20
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Bits of a place: first window, then windows, anchor less first window, and whether it is the document's last run.
_WINDOWS, _AT = 1, 8
_SHIFT = 22


def word_codes(text: bytes) -> np.ndarray:
    """A well-mixed number for each word; words are what stands between ASCII white space."""
    words, of = text.split(), xxhash.xxh3_64_intdigest
    return np.array([of(w) for w in words], np.uint64)


def _occurrences(codes: np.ndarray, width: int, k: int):
    """(edge, walk before, walk after, place) of the runs of windows with one anchor."""
    if len(codes) < width:
        return None
    runs = Runs(codes)
    hashes = runs.all(k)
    first, windows, at = [], [], []
    for a in range(0, len(codes) - width + 1, PIECE):  # pieces overlap by a window less one word
        f, n, p = anchors(hashes[a : a + PIECE + width - k], width - k + 1)
        first.append(f + a), windows.append(n), at.append(p + a)
    first, windows, at = np.concatenate(first), np.concatenate(windows), np.concatenate(at)
    ends = np.append(at[1:], 0) + k
    ends[-1] = len(codes)
    after = runs.of(at, ends)
    before = np.concatenate([[runs.of(np.array([0]), at[:1] + k)[0] ^ _START], after[:-1]])
    after[-1] ^= _END
    last = np.zeros(len(at), np.int64)
    last[-1] = 1
    place = (first << _SHIFT) | (windows << _WINDOWS) | ((at - first) << _AT) | last
    return hashes[at], before, after, place


_ROW = "e long, of long, before_lo long, before_hi long, after_lo long, after_hi long, min_doc long, max_doc long, row long, place long, more binary"


def _edges(docs: DataFrame, width: int, k: int) -> DataFrame:
    """A row for each edge and task: least and largest walk and document; one occurrence, and the places of others in more.

    Many of them go in rows of their own, dealt by their content (of: the edge)."""
    names = [f.split()[0] for f in _ROW.split(", ")]

    def fold(kept):
        e, before, after, ids, rows, place = (np.concatenate(x) for x in zip(*kept))
        order, firsts, sizes = group_rows(e)
        e, before, after, ids = (x[order] for x in (e.view(np.int64), before.view(np.int64), after.view(np.int64), ids))
        both = np.empty(len(e), PLACES)
        both["row"], both["place"] = rows[order], place[order]
        more, dealt = packs(e, firsts, sizes, both)
        columns = [*(op.reduceat(x, firsts) for x in (before, after, ids) for op in (np.minimum, np.maximum)), both["row"][firsts], both["place"][firsts]]
        for a in range(0, len(firsts), 100_000):
            some = [pa.array(c[a : a + 100_000]) for c in (e[firsts], *columns)]
            yield pa.RecordBatch.from_arrays([some[0], pa.nulls(len(some[0]), pa.int64()), *some[1:], pa.array(more[a : a + 100_000], pa.binary())], names)
        if dealt:
            key, of, packed = zip(*dealt)
            none = pa.array(np.zeros(len(key), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(of, pa.int64()), *[none] * 8, pa.array(packed, pa.binary())], names)

    def go(batches):
        remembered.clear()
        kept, n, last = [], 0, None
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), bytes_of(batch.column("text"))):
                found = _occurrences(word_codes(text), width, k) if (row, doc_id) != last else None  # repeated rows stand together
                last = (row, doc_id)
                if found is None:
                    continue
                kept.append((*found[:3], np.full(len(found[0]), doc_id), np.full(len(found[0]), row), found[3]))
                n += len(found[0])
                if n >= _GATHER:
                    yield from fold(kept)
                    kept, n = [], 0
        if kept:
            yield from fold(kept)

    return docs.mapInArrow(go, _ROW)


def compact(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(e, path) for edges (e, before, after, enters_once, leaves_once) that are linked to another: path is the first
    edge of the nonbranching path. Edges without links are left out: each is its own path."""
    out = edges.where("leaves_once").select(F.col("e").alias("u"), F.col("after").alias("walk"))
    into = edges.where("enters_once").select("e", F.col("before").alias("walk"))
    now = saved(out.join(into, "walk").where("u <> e").groupBy("e").agg(F.min("u").alias("path")), "links")  # one u for each e but for hash collisions
    if now.isEmpty():
        return now
    last = now
    for _ in range(max_rounds):
        back = now.select(F.col("e").alias("_e"), F.col("path").alias("_path"))
        step = now.join(back, F.col("path") == F.col("_e"), "left").select("e", F.coalesce("_path", "path").alias("path"), F.col("_e").isNotNull().alias("moved"))
        step = saved(step, "paths")
        used_up(last)
        last = step
        now = step.select("e", "path")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("paths did not settle")
    return now.union(now.select(F.col("path").alias("e"), "path").distinct())


def _judge(n_words: int, place, path, ends, width: int, k: int):
    """(starts, ends) of what to verify in one document, from its repeated edges: paths, and windows over their ends."""
    order = np.argsort(place)
    place, path, ends = place[order], path[order], ends[order]
    first, windows = place >> _SHIFT, (place >> _WINDOWS) & 127
    at, last = first + ((place >> _AT) & 127), (place & 1).astype(bool)
    enters, leaves = (ends & 1).astype(bool), (ends & 2).astype(bool)
    joined = (first[1:] == first[:-1] + windows[:-1]) & leaves[:-1] & enters[1:] & (path[1:] == path[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    tail = np.append(head[1:], len(place)) - 1
    # words of each path's occurrence; where all occurrences begin or end a document, it reaches to that end
    start = np.where((first[head] == 0) & enters[head], 0, at[head])
    stop = np.where(last[tail] & leaves[tail], n_words, at[tail] + k)
    within = np.searchsorted(head, np.arange(len(place)), side="right") - 1
    lo, hi = np.maximum(first, start[within]), np.minimum(first + windows, stop[within] - width + 1)  # windows inside, half-open
    hi = np.maximum(hi, lo)
    lone = np.where(hi > lo, lo, first + windows)  # windows before lo, and from hi on, reach over an end
    before = np.repeat(first - np.concatenate([[0], np.cumsum(lone - first)[:-1]]), lone - first) + np.arange(int((lone - first).sum()))
    rest = np.where(hi > lo, first + windows - hi, 0)
    behind = np.repeat(hi - np.concatenate([[0], np.cumsum(rest)[:-1]]), rest) + np.arange(int(rest.sum()))
    whole = stop - start >= width
    check = np.concatenate([before, behind])
    return np.concatenate([start[whole], check]), np.concatenate([stop[whole], check + width])


_PART = "d1 long, d2 long, min_doc long, doc_id long, row long, at long, to long"


def _parts(joined: DataFrame, width: int, k: int) -> DataFrame:
    """Spans to verify (d1, d2: the hash of their words), and spans that go (no d1): of equal spans in one task those of
    the least doc_id go on, and the others are repeats at once."""
    names = [f.split()[0] for f in _PART.split(", ")]

    def judge(batch, kept):
        columns = [lists(batch.column(c)) for c in ("place", "path", "ends")]
        for i, (doc_id, row, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), bytes_of(batch.column("text")))):
            codes = word_codes(text)
            fits = (columns[0][i] >> _SHIFT) + width <= len(codes)  # not places of another text with this row's hash
            if not fits.any():
                continue
            at, to = _judge(len(codes), *(c[i][fits] for c in columns), width, k)
            at, to = at[to <= len(codes)], to[to <= len(codes)]
            hashes = [Runs(codes, b).of(at, to).view(np.int64) for b in (0, 1)]
            kept["spans"].append(np.stack([*hashes, np.full(len(at), doc_id), np.full(len(at), row), at, to]))
            kept["n"] += len(at)

    def out(kept):
        d1, d2, ids, rows, at, to = np.concatenate(kept["spans"], 1)
        order = np.lexsort((at, rows, ids, d2, d1))
        d1, d2, ids, rows, at, to = (x[order] for x in (d1, d2, ids, rows, at, to))
        new = changes(d1) | changes(d2)
        later = ids > ids[new][np.cumsum(new) - 1]
        s_ids, s_rows, s_at, s_to = (x[later] for x in (ids, rows, at, to))
        if len(s_ids):  # those of one row that touch are one
            by = np.lexsort((s_at, s_rows, s_ids))
            s_ids, s_rows, s_at, s_to = (x[by] for x in (s_ids, s_rows, s_at, s_to))
            cut = changes(s_ids) | changes(s_rows)
            base = np.cumsum(cut) << 40
            a, b = merged(s_at + base, s_to + base)
            s_ids, s_rows, base = s_ids[cut][(a >> 40) - 1], s_rows[cut][(a >> 40) - 1], (a >> 40) << 40
            s_at, s_to = a - base, b - base
        for a in range(0, len(s_ids), 100_000):
            s = slice(a, a + 100_000)
            none = pa.nulls(len(s_ids[s]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, *(pa.array(x[s]) for x in (s_ids, s_rows, s_at, s_to))], names)
        d1, d2, ids, rows, at, to = (x[~later] for x in (d1, d2, ids, rows, at, to))
        if len(ids):  # equal spans of one row that touch, as in a text that repeats a word, are one row
            apart = np.ones(len(ids), bool)
            np.greater(at[1:], to[:-1], out=apart[1:])
            first = np.flatnonzero(apart | changes(d1) | changes(d2) | changes(ids) | changes(rows))
            to = to[np.append(first[1:], len(to)) - 1]
            d1, d2, ids, rows, at = (x[first] for x in (d1, d2, ids, rows, at))
            for a in range(0, len(ids), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (d1, d2, ids, ids, rows, at, to)], names)

    def go(batches):
        kept: dict = {"spans": [], "n": 0}
        for batch in batches:
            judge(batch, kept)
            if kept["n"] >= _GATHER:
                yield from out(kept)
                kept = {"spans": [], "n": 0}
        if kept["spans"]:
            yield from out(kept)

    return joined.mapInArrow(go, _PART)


def removed_words(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, text, row, at, to): docs, each with the lists of its removed half-open word spans (null: none).

    A word goes if a window of `width` words over it also starts in a row with a smaller doc_id. Rows with a null doc_id
    have no order: they lose nothing and are no source. Rows that share a doc_id, with equal texts or not, are documents
    of their own and don't remove each other. Texts of any length are judged whole.
    """
    rows = doc_rows(small_batches(docs))
    # one exchange of the texts, which all three readings share
    texts = rows.where("doc_id is not null").repartition("row")
    same = Window.partitionBy("e")
    spread = _edges(texts.sortWithinPartitions("row", "doc_id"), width, k)
    for name, op in (("before_lo", F.min), ("before_hi", F.max), ("after_lo", F.min), ("after_hi", F.max), ("min_doc", F.min), ("max_doc", F.max)):
        spread = spread.withColumn(name, op(name).over(same))
    ends = F.when(F.col("before_lo") == F.col("before_hi"), 1).otherwise(0) + F.when(F.col("after_lo") == F.col("after_hi"), 2).otherwise(0)
    repeated = spread.where("of is not null or min_doc < max_doc").select("e", "of", F.col("before_lo").alias("before"), F.col("after_lo").alias("after"), ends.cast("long").alias("ends"), "row", "place", "more")
    repeated = saved(repeated, "edges")
    graph = repeated.where("of is null").groupBy("e").agg(F.first("before").alias("before"), F.first("after").alias("after"), F.first("ends").alias("ends"))
    paths = compact(graph.select("e", "before", "after", (F.col("ends") % 2 == 1).alias("enters_once"), (F.col("ends") >= 2).alias("leaves_once")))
    known = graph.join(paths, "e", "left").select("e", F.coalesce("path", "e").alias("path"), "ends")
    # a join, which can be split where an edge has very many places
    places = repeated.select(F.coalesce("of", "e").alias("e"), F.when(F.col("of").isNull(), F.col("row")).alias("row"), "place", "more").join(known.hint("merge"), "e")
    lists_of = by_row(unpacked(places, "path", "ends"), "place", "path", "ends")
    parts = _parts(texts.join(lists_of, "row").select("doc_id", "row", "text", "place", "path", "ends"), width, k)
    dealt = parts.withColumn("least", F.min("min_doc").over(Window.partitionBy("d1", "d2", F.when(F.col("d1").isNull(), F.col("row")))))
    spans = dealt.where("least < doc_id or d1 is null").select("doc_id", "row", "at", "to")
    return with_spans(texts, spans).unionByName(rows.where("doc_id is null"), allowMissingColumns=True)


def digest(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of docs(doc_id, text, ...).

    Null text or none but white space: no words. See removed_words for ids that are null or repeated and for long texts.
    Empty table: no rows. Other columns are ignored.
    """

    def go(batches):
        for batch in batches:
            rows = []
            for text, at, to in zip(bytes_of(batch.column("text")), lists(batch.column("at")), lists(batch.column("to"))):
                words = text.split()
                at, to = merged(at, np.minimum(to, len(words)))
                rows.append((len(words), int((to - at).sum()), hashlib.sha256(b" ".join(kept_words(words, at, to))).hexdigest()))
            made = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in made[:2]), pa.array(made[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed_words(docs, **settings).mapInArrow(go, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_words(words: list[bytes], at: np.ndarray, to: np.ndarray) -> list[bytes]:
    if not len(at):
        return words
    edges = [0, *np.stack([at, to], 1).ravel().tolist(), len(words)]
    return [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]


def op3_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
