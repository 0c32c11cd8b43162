"""Repeated byte strings found with induced suffix arrays, shard by shard.

1. Every 100-byte window of every text has an anchor; anchors that occur once are dropped by a count over all texts.
2. The bytes around the others are cut out: one segment for each run of windows with the same anchor. A task combines
   equal segments before they move, as sums are combined: the earliest place goes on, and later ones are repeats of it.
3. Segments with the same anchor come together in a shard. A shard is suffix-sorted by recursive induction; its permuted
   common prefixes tell which windows share 100 bytes with their neighbour in the order, and of each such group the
   earliest window stays. An anchor with very many occurrences is cut into single windows, dealt out by their content.
4. Each document's removed spans are united and its remaining bytes hashed.

Every window is judged: step 1 drops only windows that cannot repeat. Rows are told apart by a hash of id and text, and
the id gives the order alone, so that rows which share an id keep what is theirs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, mix, remembered, saved, small_batches, table
from .spans import PIECE, PLACES, Runs, anchors, by_row, changes, doc_rows, group_rows, lists, merged, packs, unpacked, with_spans
from .suffix_sort import permuted_common_prefixes, suffix_array

WIDTH = 100
#: Bytes that an anchor is a hash of.
RUN = 32
#: Occurrences from which an anchor's windows are dealt out one by one.
HOT = 8_000
SHARD_BYTES = 3 << 20
#: Occurrences that one task gathers before it hands on what it has folded.
_GATHER = 1 << 20

_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(text: bytes, width: int, run: int):
    """(anchor hash, first window, number of windows) of each run of windows in a text, in pieces."""
    for a in range(0, max(0, len(text) - width + 1), PIECE):
        raw = np.frombuffer(text, np.uint8, min(len(text) - a, PIECE + width - 1), a)
        hashes = Runs(_CODES[raw]).all(run)
        first, count, at = anchors(hashes, width - run + 1)
        yield hashes[at], first + a, count


_ANCHORS = "h long, of long, row long, place long, others long, more binary"


def _anchored(docs: DataFrame, width: int, run: int) -> DataFrame:
    """A row (h, row, place, others, more) for each anchor and task: place is first window * 128 + windows, others the
    number of further occurrences, more their places. Many of them go in rows of their own, dealt by their content (of: the anchor)."""
    names = [f.split()[0] for f in _ANCHORS.split(", ")]

    def fold(kept):
        h, rows, place = (np.concatenate(x) for x in zip(*kept))
        order, firsts, sizes = group_rows(h)
        h, both = h[order].view(np.int64), np.empty(len(h), PLACES)
        both["row"], both["place"] = rows[order], place[order]
        more, dealt = packs(h, firsts, sizes, both)
        for a in range(0, len(firsts), 100_000):
            some = firsts[a : a + 100_000]
            columns = [pa.array(h[some]), pa.nulls(len(some), pa.int64()), pa.array(both["row"][some]), pa.array(both["place"][some]), pa.array(sizes[a : a + 100_000] - 1), pa.array(more[a : a + 100_000], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        if dealt:
            key, of, packed = zip(*dealt)
            none = pa.array(np.zeros(len(key), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(of, pa.int64()), none, none, none, pa.array(packed, pa.binary())], names)

    def go(batches):
        remembered.clear()
        kept, n, before = [], 0, None
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), bytes_of(batch.column("text"))):
                if (row, doc_id) == before:  # a repeated row: they stand together
                    continue
                before = (row, doc_id)
                for h, first, count in _runs(text, width, run):
                    kept.append((h, np.full(len(h), row), first * 128 + count))
                    n += len(h)
                if n >= _GATHER:
                    yield from fold(kept)
                    kept, n = [], 0
        if kept:
            yield from fold(kept)

    return docs.mapInArrow(go, _ANCHORS)


class _Folded:
    """Segments by content: the earliest place of each; places behind it are repeats at once."""

    def __init__(self):
        self.first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        self.level: list[tuple[int, int, int, int, bytes]] = []  # of another row with the same doc_id: neither is earlier
        self.repeats: list[tuple[int, int, int, int]] = []
        self.bytes = 0

    def add(self, key: int, segment: bytes, place: tuple[int, int, int]) -> None:
        """place: (doc_id, row, at)."""
        old = self.first.setdefault((key, segment), place)
        if old == place:
            self.bytes += len(segment)
        elif old[0] == place[0] and old[1] != place[1]:
            self.level.append((key, *place, segment))
            self.bytes += len(segment)
        else:
            if place < old:
                self.first[key, segment], place = place, old
            self.repeats.append((*place, place[2] + len(segment)))


_PART = "h long, doc_id long, row long, at long, to long, segment binary"


def _part(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, segment = zip(*rows) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(segment, pa.binary())], [f.split()[0] for f in _PART.split(", ")])


def _joined_repeats(repeats: list[tuple[int, int, int, int]]) -> list[tuple]:
    """Repeats as rows without a segment; those of one row that touch are one."""
    out: list[list] = []
    for doc_id, row, at, to in sorted(repeats):
        if out and out[-1][1:3] == [doc_id, row] and at <= out[-1][4]:
            out[-1][4] = max(out[-1][4], to)
        else:
            out.append([None, doc_id, row, at, to, None])
    return [tuple(x) for x in out]


def _segments(joined: DataFrame, width: int, most_bytes: int = 16 << 20) -> DataFrame:
    """From (doc_id, row, text, h, place, hot): segments (h, doc_id, row, at, to, segment), and repeats, which have no segment."""

    def out(folded: _Folded):
        rows = [(h, *place, place[2] + len(segment), segment) for (h, segment), place in folded.first.items()]
        rows += [(h, doc_id, row, at, at + len(segment), segment) for h, doc_id, row, at, segment in folded.level]
        rows += _joined_repeats(folded.repeats)
        for a in range(0, len(rows), 20_000):
            yield _part(rows[a : a + 20_000])

    def go(batches):
        folded = _Folded()
        for batch in batches:
            hs, places, hots = (lists(batch.column(c)) for c in ("h", "place", "hot"))
            for k, (doc_id, row, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), bytes_of(batch.column("text")))):
                for h, place, hot in zip(hs[k].tolist(), places[k].tolist(), hots[k].tolist()):
                    first, windows = place >> 7, place & 127
                    if not hot:
                        folded.add(h, text[first : first + windows + width - 1], (doc_id, row, first))
                        continue
                    for at in range(first, first + windows):
                        one = text[at : at + width]
                        folded.add(int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True), one, (doc_id, row, at))
                if folded.bytes + 64 * len(folded.repeats) > most_bytes:
                    yield from out(folded)
                    folded = _Folded()
        yield from out(folded)

    return joined.mapInArrow(go, _PART)


def repeated_windows(segments: list[bytes], docs: np.ndarray, rows: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the bytes covered by windows that also start in a smaller doc, or before in the same row.

    Segments count as separate texts and stand in the order of (docs, rows, place in the row).
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # a byte that no UTF-8 text has
    windows = np.maximum(sizes - width + 1, 0)
    if not windows.any():
        return []
    order = suffix_array(np.append(text.astype(np.int32) + 1, 0))[1:]
    group = np.cumsum(permuted_common_prefixes(text, order, width)[order] < width)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    is_start = np.arange(len(text)) - firsts[owner] < windows[owner]
    some = is_start[order]
    at, group = order[some], group[some]
    by = np.argsort(group * len(text) + at)
    at, group = at[by], group[by]
    number = np.cumsum(changes(docs) | changes(rows))[owner[at]]
    new = changes(group)
    least = docs[owner[at[new]]][np.cumsum(new) - 1]
    gone = (docs[owner[at]] > least) | ~(new | changes(number))
    found = np.sort(at[gone])
    if not len(found):
        return []
    own = owner[found]
    begin = np.flatnonzero(changes(found - np.arange(len(found))) | changes(own))
    last = np.append(begin[1:], len(found)) - 1
    base = firsts[own[begin]]
    return list(zip(own[begin].tolist(), (found[begin] - base).tolist(), (found[last] - base + width).tolist()))


def _shard_rows(batches, width: int, shard_bytes: int):
    """Batches (doc_id, row, at, to) of the repeats in batches of segments that stand in the order of h."""

    repeats: list[tuple] = []  # known from combining equal segments
    kept: list[tuple] = []  # to be sorted
    group: list[tuple] = []  # rows of the anchor at hand
    size, last = 0, None

    def close() -> int:
        folded = _Folded()  # the other side of the tasks' combining
        for h, doc_id, row, at, segment in group:
            folded.add(h, segment, (doc_id, row, at))
        repeats.extend(folded.repeats)
        group.clear()
        if len(folded.first) == 1 and not folded.level:  # one content has no window twice: each has the anchor elsewhere
            return 0
        kept.extend((*place, segment) for (_, segment), place in folded.first.items())
        kept.extend(x[1:] for x in folded.level)
        return folded.bytes

    def resolve():
        rows = sorted(set(kept))
        spans = repeated_windows([x[3] for x in rows], np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), width) if rows else []
        found = _joined_repeats(repeats + [(*rows[k][:2], rows[k][2] + a, rows[k][2] + b) for k, a, b in spans])
        repeats.clear(), kept.clear()
        for a in range(0, len(found), 100_000):
            some = list(zip(*found[a : a + 100_000]))
            yield pa.RecordBatch.from_arrays([pa.array(some[i], pa.int64()) for i in (1, 2, 3, 4)], ["doc_id", "row", "at", "to"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "row", "at", "segment"))):
            if row[0] != last:
                size += close() if group else 0
                last = row[0]
                if size > shard_bytes or len(repeats) > 200_000:
                    yield from resolve()
                    size = 0
            group.append(row)
    if group:
        close()
    yield from resolve()


def removed_spans(docs: DataFrame, width: int = WIDTH, run: int = RUN, hot: int = HOT, shard_bytes: int = SHARD_BYTES, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, row, c0, c1, ..., at, to): docs, with the carried columns as c0 and so on, each with the lists of
    its removed half-open byte spans (null: none).

    A byte goes if a string of `width` bytes over it also starts earlier: in a row with a smaller doc_id, or before in
    the same row. Rows with a null doc_id have no order: they lose nothing and are no source. Rows that share a doc_id,
    with equal texts or not, are documents of their own and don't remove each other. Texts of any length are judged
    whole; one of less than `width` bytes loses nothing.
    """
    rows = doc_rows(small_batches(docs), carried)
    # one exchange of the texts, which all three readings below share: each takes all its columns, so that none is another
    texts = rows.where("doc_id is not null").repartition("row")
    here = Window.partitionBy("h")
    counted = _anchored(texts.sortWithinPartitions("row", "doc_id"), width, run).withColumn("n", F.sum(F.col("others") + 1).over(here))
    counted = saved(counted.where("n > 1 or of is not null"), "anchors")
    # what a task had many of is known to repeat; only whether its anchor is hot is looked up
    many = counted.where("of is null").where(F.col("n") > hot).select(F.col("h").alias("_h")).distinct()
    few = counted.where("of is null").select("h", "row", "place", (F.col("n") > hot).cast("long").alias("hot"), "more")
    packed = counted.where("of is not null").join(many, F.col("of") == F.col("_h"), "left")
    packed = packed.select(F.col("of").alias("h"), F.lit(None).cast("long").alias("row"), F.lit(0).cast("long").alias("place"), F.col("_h").isNotNull().cast("long").alias("hot"), "more")
    lists_of = by_row(unpacked(few.union(packed), "h", "hot"), "h", "place", "hot")
    parts = _segments(texts.join(lists_of, "row"), width)
    dealt = parts.repartition(F.col("h"), F.when(F.col("h").isNull(), F.col("row"))).sortWithinPartitions("h")
    return with_spans(texts, _resolved(dealt, width, shard_bytes)).unionByName(rows.where("doc_id is null"), allowMissingColumns=True)


def _resolved(dealt: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Repeats known before, and those found in the shards, from one pass over both."""

    def go(batches):
        def own(kept):
            for batch in batches:
                known = batch.filter(batch.column("h").is_null())
                if known.num_rows:
                    kept.append(known.select(["doc_id", "row", "at", "to"]))
                yield batch.filter(batch.column("h").is_valid())

        kept: list[pa.RecordBatch] = []
        for batch in _shard_rows(own(kept), width, shard_bytes):
            yield from kept
            kept.clear()
            yield batch
        yield from kept

    return dealt.mapInArrow(go, "doc_id long, row long, at long, to long")


def digest(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs(doc_id, text, ...).

    Null or empty text: no bytes. See removed_spans for ids that are null or repeated and for long texts. Empty table:
    no rows. Other columns are ignored.
    """

    def go(batches):
        for batch in batches:
            rows = []
            for text, at, to in zip(bytes_of(batch.column("text")), lists(batch.column("at")), lists(batch.column("to"))):
                at, to = merged(at, np.minimum(to, len(text)))
                rows.append((len(text), int((to - at).sum()), len(at), hashlib.sha256(without(text, at, to)).hexdigest()))
            made = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in made[:3]), pa.array(made[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs, **settings).mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(text: bytes, at: np.ndarray, to: np.ndarray) -> bytes:
    """text but for the ordered spans."""
    if not len(at):
        return text
    edges = [0, *np.stack([at, to], 1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def cut_repeats(docs: DataFrame, **settings) -> DataFrame:
    """docs, with its own columns, each text without its repeated bytes; n_chars, if there, is the new length of a
    text that was cut. Of a character that is cut apart the rest is dropped too.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    inner = {"doc_id": "doc_id", "text": "text"} | {c: f"c{i}" for i, c in enumerate(others)}

    def go(batches):
        for batch in batches:
            texts, lengths = batch.column("text").to_pylist(), None
            if "n_chars" in inner:
                lengths = batch.column(inner["n_chars"]).to_pylist()
            for k, (at, to) in enumerate(zip(lists(batch.column("at")), lists(batch.column("to")))):
                if len(at):
                    raw = texts[k].encode()
                    texts[k] = without(raw, *merged(at, np.minimum(to, len(raw)))).decode("utf-8", "ignore")
                    if lengths:
                        lengths[k] = len(texts[k])
            made = {"text": pa.array(texts, pa.string())}
            if lengths:
                made["n_chars"] = pa.array(lengths, batch.schema.field(inner["n_chars"]).type)
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(inner[c])) for c in docs_columns], docs_columns)

    docs_columns, schema = docs.columns, docs.schema
    return removed_spans(docs, carried=others, **settings).mapInArrow(go, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
